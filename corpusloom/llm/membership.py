"""Filters of fixed size that tell which longs may be in a set, and which are surely not.

They keep rows that no join needs out of shuffles; exact joins drop what passes beside. The
size does not grow with the data, so a filter can always be broadcast; where very many values
are put in, it lets more pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15


def bit_set(values: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bit set of fixed size (a power of two) of the longs in the one column of ``values``.

    The longs are hashes, of which the low bits name the slot; nulls are left out.
    """
    slot = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1)) + 1
    found = values.where(F.col(values.columns[0]).isNotNull()).groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("held"))
    out = np.zeros(max(bits, BITMAP) // 8, np.uint8)
    # At most bits / BITMAP rows, whatever the data.
    for at, held in found.collect():
        out[(at - 1) * BITMAP // 8 : at * BITMAP // 8] = np.frombuffer(held, np.uint8)
    return out


def maybe_in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each long may be in the set of ``bit_set``."""
    slot = values.astype(np.int64) & (8 * len(held) - 1)
    return (held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
