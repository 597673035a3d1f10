"""Best assignments equal brute force over all of them."""

import itertools
import random
from collections import defaultdict

import pytest

from corpusloom.operators import scoring


def brute(weights):
    """Greatest total over all ways to pair."""
    lefts, rights = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    best = 0
    for chosen in itertools.product([None, *rights], repeat=len(lefts)):
        used = [b for b in chosen if b is not None]
        if len(used) == len(set(used)) and all(b is None or (a, b) in weights for a, b in zip(lefts, chosen)):
            best = max(best, sum(weights[a, b] for a, b in zip(lefts, chosen) if b is not None))
    return best


def test_best_pairs_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        weights = {(a, b): rnd.randrange(1, 20) for a in range(rnd.randrange(1, 5)) for b in range(rnd.randrange(1, 5)) if rnd.random() < 0.7}
        found = scoring.best_pairs(weights) if weights else []
        assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found)
        assert sum(weights[p] for p in found) == brute(weights)


@pytest.mark.parametrize("tolerance", [0, 5])
def test_matter_scores(spark, tolerance):
    rnd = random.Random(tolerance)
    rows = defaultdict(list)
    for case in range(40):
        for side in ("gold", "found"):
            for item in range(rnd.randrange(0, 5)):
                lo = rnd.randrange(150)
                rows[side].append((case, rnd.choice("xy"), item, lo, lo + rnd.randrange(1, 60)))
    gold, found = (spark.createDataFrame(rows[s], "case_id bigint, kind string, item bigint, lo bigint, hi bigint") for s in ("gold", "found"))
    got = {r["case_id"]: (r["recall"], r["precision"], r["f1"]) for r in scoring.matter_scores(gold, found, {"x": 3.0}, 0.3, tolerance).collect()}
    for case in range(40):
        won = {}
        sums = {s: sum(3.0 if r[1] == "x" else 1.0 for r in rows[s] if r[0] == case) for s in rows}
        for kind in "xy":
            weights = {}
            for g in rows["gold"]:
                for f in rows["found"]:
                    if g[:2] == f[:2] == (case, kind):
                        shared = min(g[4], f[4]) - max(g[3], f[3]) + 2 * tolerance
                        whole = max(g[4], f[4]) - min(g[3], f[3]) + 2 * tolerance
                        w = shared * scoring.FULL // whole
                        if shared > 0 and w >= 0.3 * scoring.FULL:
                            weights[g[2], f[2]] = w
            won[kind] = brute(weights) * (3.0 if kind == "x" else 1.0) / scoring.FULL if weights else 0
        total = sum(won.values())
        if not sums["gold"] and not sums["found"]:
            assert case not in got
            continue
        want = (total / sums["gold"] if sums["gold"] else None, total / sums["found"] if sums["found"] else None, 2 * total / (sums["gold"] + sums["found"]) if sums["gold"] and sums["found"] else None)
        assert got[case] == pytest.approx(want, abs=2e-6)


def test_only_shared_clusters_are_paired(spark, monkeypatch):
    """A pair alone in its cluster is chosen without a search, unless it weighs nothing."""
    rows = [(1, "A", 1, 2, 700_000, 1), (1, "A", 3, 4, 0, 2), (2, "A", 1, 2, 600_000, 1), (2, "A", 1, 4, 900_000, 1)]
    pairs = spark.createDataFrame(rows, "case_id bigint, kind string, gold bigint, found bigint, weight bigint, cluster bigint")
    seen = []
    monkeypatch.setattr(scoring, "best_pairs", lambda w, plain=scoring.best_pairs: seen.append(len(w)) or plain(w))
    monkeypatch.setattr(scoring, "map_groups", lambda df, key, work, schema: spark.createDataFrame(work(df.toPandas()), schema))
    got = scoring.assign(pairs).collect()
    assert sorted((r["case_id"], r["gold"], r["found"]) for r in got) == [(1, 1, 2), (2, 1, 4)] and seen == [2]
