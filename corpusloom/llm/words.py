"""Hashes of words, taken from Arrow text columns without a Python object a word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Its hash mixes the word's bytes in steps of eight with its length.

Defined results: null texts count as empty; a text of n line feeds has n + 1 lines; a line of
white space has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Masks that keep the first bytes of a little-endian number of eight.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 256


class Run(NamedTuple):
    """Words of some rows that follow each other, from row ``start`` on."""

    start: int
    lines_of_row: np.ndarray
    words_of_line: np.ndarray
    hashes: np.ndarray


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])


def runs(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[Run]:
    """Words of the lower-cased texts of a column, about ``most_bytes`` together, a row at least."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    sizes = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(sizes, int(sizes[at]) + most_bytes, "right")) - 1)
        # A line feed behind each text ends its last word and line.
        part = pc.binary_join_element_wise(pc.utf8_lower(column.slice(at, upto - at).fill_null("")), "", "\n")
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        offsets = np.frombuffer(part.buffers()[1], kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        text = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts, ends = word_bounds(text)
        feeds = np.flatnonzero(text == 10)
        lines = np.searchsorted(feeds, offsets - offsets[0])
        yield Run(at, np.diff(lines), np.diff(np.searchsorted(starts, feeds), prepend=0), word_hashes(text, starts, ends))
        at = upto


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in bytes that end with white space."""
    space = SPACE[text]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text) + 1,), "<u8", buffer=padded, strides=(1,))
    n = ends - starts
    h = mixed((eights[starts] & FIRST[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(at):
        h[at] = mixed(h[at] * np.uint64(0x9E3779B97F4A7C15) + (eights[starts[at] + k] & FIRST[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]].data)
    return h
