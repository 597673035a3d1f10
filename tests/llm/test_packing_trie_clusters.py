"""Packing, prefix trie and centroid clustering against plain versions and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpusloom.llm import clustering, mixing, packing, prefix_trie, queries
from corpusloom.tables import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def test_encoder_equals_library(tokenizer):
    encoder = packing.Encoder(open(WORDS, encoding="utf-8").read())
    rnd = random.Random(7)
    texts = ["", " ", "a", "It's  we'll\n\n DON'T", "<|endoftext|> x<|startoftext|>", "é ́a", "ΟΔΟΣ ΣΑΣ. Σ", "İstanbul", " x y z\x1cw\x85v", "w" * 5000, "!?" * 900, "각 1234", "\x00\x01 ﻿"]
    alphabet = list("abcABÇİıſσΣéñ'’ \n\t\r 　́̇12!?<|>🙂漢字‍") + ["'s", " 'LL", "<|endoftext|>", "ﬁ"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(300))) for _ in range(300)]
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(rows, docs, tokenizer, capacity):
    """Pieces hold each document's ids in order, and fill sequences without gaps."""
    want = Counter()
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[(d, p, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_query(spark, tokenizer):
    rows = queries.op11_pack_two_fit(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    n = check_packing(rows, docs, tokenizer, 4096)
    assert n == math.ceil(sum(r["length"] for r in rows) / 4096)


def test_pack_odd_rows(spark, tokenizer):
    texts = [None, "", "a b c", "a b c", "x " * 41, "y " * 19, "z" * 400, "1 " * 20]
    docs = [(i if i else None, t) for i, t in enumerate(texts)] + [(2, "a b c")] * 9
    df = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", F.lit(1).alias("Text"), F.lit(2).alias("a.b"), F.lit("x").alias("part"), F.lit(3).alias("nth"))
    packed = packing.pack(df, WORDS, 20, with_ids=True)
    rows = packed.collect()
    check_packing(rows, docs, tokenizer, 20)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in rows:
        ids = whole[r["sequence_id"]]["ids"]
        assert ids[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert sum(r["n_tokens"] for r in whole.values()) == sum(r["length"] for r in rows)
    assert packing.pack(df.limit(0), WORDS).collect() == []


def bins_of(counts):
    """The bins that a plan makes, and a check that every document has one place."""
    plan = packing.Plan(np.array(counts))
    held, placed = defaultdict(list), Counter()
    runs = [tuple(r) for r in plan.runs.tolist()]
    for i, (length, first, sequence, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for n in range(first, end):
            held[sequence + n - first].append((offset, length))
            placed[length] += 1
    assert placed == Counter({x: n for x, n in enumerate(counts) if n})
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at < len(counts)
    assert sorted(held) == list(range(plan.sequences))
    return [sorted((x for _, x in places), reverse=True) for places in held.values()]


def one_by_one(counts):
    """Best-two-fit, a bin at a time, over a plain list."""
    left = sorted((x for x, n in enumerate(counts) for _ in range(n)), reverse=True)
    capacity, bins = len(counts) - 1, []
    while left:
        held, rest = [], []
        for x in left:
            (held if sum(held) + x <= capacity else rest).append(x)
        gap, smallest = capacity - sum(held), held[-1]
        pairs = [(a + b, a, b) for i, a in enumerate(rest) for b in rest[i + 1 :] if smallest < a + b <= gap + smallest] if gap else []
        if pairs:
            best = max(p[0] for p in pairs)
            _, a, b = max((p for p in pairs if p[0] == best), key=lambda p: p[1])
            held[-1:] = [a, b]
            rest.remove(a), rest.remove(b)
            rest = sorted([*rest, smallest], reverse=True)
        bins.append(sorted(held, reverse=True))
        left = rest
    return bins


def test_plan_equals_one_by_one():
    rnd = random.Random(2)
    for _ in range(300):
        capacity = rnd.choice([5, 12, 40])
        counts = [0] + [rnd.choice([0, 0, 1, 2, 7]) for _ in range(capacity)]
        assert sorted(bins_of(counts)) == sorted(one_by_one(counts))
    big = np.zeros(4097, int)
    big[[1, 3, 700, 1366, 2049, 4096]] = [10**6, 5, 10**9, 10**7, 10**7, 3]
    plan = packing.Plan(big)
    assert plan.sequences >= math.ceil((big * np.arange(4097)).sum() / 4096) and len(plan.runs) < 20_000


# Ranges of the mix


@pytest.mark.parametrize("same", [False, True])
def test_mix_ranges_are_even(spark, same):
    """Low weights, and null ids that all draw the same key, spread over all ranges alike."""
    rows = spark.range(20_000).select(F.lit("s").alias("source"), F.when(F.lit(not same), F.col("id")).alias("doc_id"), F.lit(7).cast("long").alias("size"), F.lit(0.25).alias("quality"), F.monotonically_increasing_id().alias("row"))
    keyed = rows.withColumn("key", -F.log(mixing.uniform("doc_id")) / F.col("quality"))
    counts = [r["count"] for r in mixing.in_ranges(keyed).groupBy("at").count().collect()]
    assert len(counts) == 8 and max(counts) < 2 * 20_000 / 8


# Prefix trie


def plain_trie(rows):
    """Nodes by the contract, from a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, prefix_key(role, text), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = {}
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in inside if len(p) == len(path) + 1]
        leaves = [p for p in inside if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in inside)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in inside if p)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out[(min(members), len(path))] = (parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def prefix_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def trie_of(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-5, 45), 100, *range(201, 230), 4_000_000_000]:
        for turn in range(rnd.randrange(5)):
            rows.append((c, rnd.choice([turn, turn, turn, None]), rnd.choice(["user", "user", None, ""]), rnd.choice(["hi", "hi", "yo 🙂", None, "", "user"])))
    rows += [(7, 1, "user", "same")] * 6 + [(None, 1, "user", "lost")]
    rows += [(300 + c, t, "user", f"turn {t}") for c in range(3) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit("x").alias("Conv_ID"), F.lit(1).alias("a.b"), F.lit(2).alias("part"))
    assert trie_of(prefix_trie.conversation_trie(df)) == plain_trie(rows)


def test_trie_small(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, 1, "user", "one"), (5, 2, "user", "two")]
    assert trie_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, schema))) == plain_trie(rows)
    rows = [(c, 0, "user", "hi") for c in (101, 102)]
    assert trie_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, schema))) == plain_trie(rows)


# Centroid clustering


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, n) in zip(kept, at) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    at, per = assign(), Counter()
    for d, n in at:
        per[n] += d
    most = clustering.LARGEST
    return Counter((i, n, d, min(per[n], most), min(sum(per.values()), most), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at))


@pytest.mark.parametrize("wide", [1.0, 3e6])
def test_clusters_equal_plain(spark, wide):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.25, 1.0]) * wide for _ in range(4)]) for i in range(90)]
    rows += [(3, [0.25] * 4)] * 5 + [(None, [0.5] * 4), (None, None), (900, [1.0] * 3), (901, []), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [None, 0.0, 0.0, 0.0]), (905, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", F.lit(1).alias("Embedding"), F.lit(1).alias("a.b"), F.lit("x").alias("seed"), F.lit(2).alias("v")).repartition(5)
    for k in (1, 7, 500):
        got = clustering.cluster_report(df, k=k, rounds=3, dims=4).collect()
        assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == plain_clusters(rows, k, 3, 4)
    assert clustering.cluster_report(df.limit(0), dims=4).collect() == []
    far = spark.createDataFrame([(1, [3e38, 0.0, 0.0, 0.0]), (2, [-3e38, 0.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert {r["distance"] for r in clustering.cluster_report(far, k=1, rounds=1, dims=4).collect()} == {clustering.LARGEST}


def test_annulus_skips_far_norms():
    """Only centroids of the annulus are compared."""
    index = clustering.Annulus([[10 * n, 0] for n in range(20)])
    seen = []
    measure = index.distance
    index.distance = lambda v, at: seen.append(len(v)) or measure(v, at)
    at, d = index.nearest(np.array([[52, 0], [0, 49], [191, 2]]), np.array([5, 5, 19]))
    assert at.tolist() == [5, 0, 19] and d.tolist() == [4, 2401, 5] and sum(seen) < 3 + 15
