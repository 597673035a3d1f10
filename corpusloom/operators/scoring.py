"""Scores of found items against gold items by the best assignment.

Items are spans of a kind in a case. A gold and a found item may be paired if they are of one
kind and overlap enough, within a tolerance; the weight of a pair is its overlap. Of all ways
to pair them the one of greatest total weight counts. Spans that no chain of overlaps connects
can't affect each other, so a case is parted into clusters of overlapping spans by a window;
only the admissible pairs of a cluster meet in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.grouping import map_groups

#: Weight of a full overlap; weights are whole numbers, so sums and ties are exact.
FULL = 1_000_000
#: Width of the stretches on which spans meet.
STRETCH = 64


def admissible(gold: DataFrame, found: DataFrame, least: float = 0.5, tolerance: int = 0) -> DataFrame:
    """Pairs of items (case_id, kind, item, lo, hi): case_id, gold, found, weight, cluster.

    Spans are widened by the tolerance on both sides before they are compared. They meet on
    stretches of the text, not on their case.
    """

    def stretched(df: DataFrame, item: str, lo: str, hi: str) -> DataFrame:
        at = F.sequence(F.floor((F.col("lo") - tolerance) / STRETCH), F.floor((F.col("hi") + tolerance) / STRETCH))
        return df.select("case_id", "kind", F.col("item").alias(item), (F.col("lo") - tolerance).alias(lo), (F.col("hi") + tolerance).alias(hi), F.explode(at).alias("at"))

    met = stretched(gold, "gold", "a", "b").join(stretched(found, "found", "c", "d"), ["case_id", "kind", "at"]).drop("at").distinct()
    shared, whole = F.least("b", "d") - F.greatest("a", "c"), F.greatest("b", "d") - F.least("a", "c")
    pairs = met.withColumn("weight", F.floor(shared * FULL / whole).cast("long")).where((shared > 0) & (F.col("weight") >= int(least * FULL)))
    order = Window.partitionBy("case_id", "kind").orderBy("low", "high", "gold", "found")
    reach = pairs.withColumns({"low": F.least("a", "c"), "high": F.greatest("b", "d")})
    ahead = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = reach.withColumn("new", F.when(F.col("low") < ahead, 0).otherwise(1))
    return parted.select("case_id", "kind", "gold", "found", "weight", F.sum("new").over(order).alias("cluster"))


def best_pairs(weights: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The pairing of greatest total weight of left and right items.

    Pairs are added along the alternating path that gains most, until none gains.
    """
    right_of: dict[int, int] = {}
    left_of: dict[int, int] = {}
    lefts = sorted({a for a, _ in weights})
    while True:
        gain = {a: 0 for a in lefts if a not in right_of}
        came: dict[int, int] = {}
        reached: dict[int, int] = {}
        for _ in range(2 * len(lefts) + 1):
            changed = False
            for (a, b), w in weights.items():
                if a in gain and right_of.get(a) != b and gain[a] + w > reached.get(b, -FULL * FULL):
                    reached[b], came[b], changed = gain[a] + w, a, True
                    back = left_of.get(b)
                    if back is not None:
                        gain[back] = reached[b] - weights[back, b]
            if not changed:
                break
        free = [(v, -b) for b, v in reached.items() if b not in left_of]
        if not free or max(free)[0] <= 0:
            return sorted(right_of.items())
        b = -max(free)[1]
        while b is not None:
            a = came[b]
            after = right_of.get(a)
            right_of[a], left_of[b] = b, a
            b = after


def assign(pairs: DataFrame) -> DataFrame:
    """The chosen pairs of ``admissible``: case_id, kind, gold, found, weight."""
    kind = pairs.schema["case_id"].dataType.simpleString()

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        cluster = ["case_id", "kind", "cluster"]
        # A pair alone in its cluster is chosen as it stands.
        chosen = (frame["weight"] > 0).to_numpy(copy=True)
        shared = np.flatnonzero(frame.groupby(cluster)["gold"].transform("size") > 1)
        part = frame.iloc[shared]
        g, f, w = part["gold"].tolist(), part["found"].tolist(), part["weight"].tolist()
        for at in part.groupby(cluster).indices.values():
            best = set(best_pairs({(g[i], f[i]): w[i] for i in at}))
            chosen[shared[at]] = [(g[i], f[i]) in best for i in at]
        return frame.loc[chosen, ["case_id", "kind", "gold", "found", "weight"]]

    keyed = pairs.withColumn("cell", F.xxhash64("case_id", "kind", "cluster"))
    return map_groups(keyed, "cell", work, f"case_id {kind}, kind string, gold bigint, found bigint, weight bigint")


def matter_scores(gold: DataFrame, found: DataFrame, kinds: dict[str, float], least: float = 0.5, tolerance: int = 0) -> DataFrame:
    """Scores of each case: weights by kind (others 1), recall, precision and F1 of the best pairing.

    Each item counts its kind's weight; a pair counts it by its overlap. A case without gold
    items has no recall, one without found items no precision.
    """
    value = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind")), F.lit(1.0))
    got = assign(admissible(gold.select("case_id", "kind", "item", "lo", "hi"), found.select("case_id", "kind", "item", "lo", "hi"), least, tolerance))
    total = lambda df, name: df.groupBy("case_id").agg(F.sum(value).alias(name))
    won = got.groupBy("case_id").agg(F.sum(F.col("weight") * value / FULL).alias("won"))
    per = total(gold, "wanted").join(total(found, "given"), "case_id", "full").join(won, "case_id", "left")
    won_or_none = F.coalesce("won", F.lit(0.0))
    recall, precision = won_or_none / F.col("wanted"), won_or_none / F.col("given")
    f1 = F.when(F.col("wanted").isNotNull() & F.col("given").isNotNull(), 2 * won_or_none / (F.col("wanted") + F.col("given")))
    return per.select("case_id", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))
