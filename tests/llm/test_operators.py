"""Operators of the llm subpackage against plain versions and on odd inputs."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from corpusloom.llm import ann, bpe, chat, embedding_dedup, html_text, line_dedup, mixing, quality, queries, simhash, toxicity
from corpusloom.tables import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(reference):
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rnd = random.Random(3)
    texts = ["", " ", "a", "naïve café", "  two  blanks\n\n\tx", "<|endoftext|>", " " * 3000, "ab" * 2000, "!?" * 700, "\U0001f642é​" * 90, "x" * 257, "\x00\x01"]
    texts += ["".join(rnd.choice("abcdeé🙂 \n'!1") for _ in range(rnd.randrange(400))) for _ in range(200)]
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode_bytes(ids) == text.encode()


def test_bpe_query_and_decoding(spark, reference):
    got = queries.op2_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r["text"] or "")
        assert got.loc[r["doc_id"], "n_tokens"] == len(ids)
        assert got.loc[r["doc_id"], "ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.loc[r["doc_id"], "decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    docs = docs_of(spark, ["a b", None, ""]).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    coded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {0: "a b", 1: "", 2: ""}
    assert coded.where("n_tokens = 0").select("ids_sha256").distinct().first()[0] == hashlib.sha256(b"").hexdigest()


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "A b C", "É b c d", "a b c d e f a b c d", "x y z\x0bw q", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_query(spark):
    got = queries.op7_simhash_trie(spark, SF).toPandas().set_index("doc_id")
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in table(spark, SF, "documents").collect()}
    union = Union()
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                union.join(a, b)
    for i, v in fps.items():
        assert (got.loc[i, "fingerprint"], got.loc[i, "component_id"]) == (f"{v:016x}", union.find(i))


def test_simhash_links_crowded(spark, monkeypatch):
    """Groups beyond a task's share give the components of brute force."""
    monkeypatch.setattr(simhash, "ROOT_LEAVES", 40)
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for _ in range(8):
        centre = rnd.getrandbits(64)
        for _ in range(50):
            v = centre
            for _ in range(rnd.randrange(7)):
                v ^= 1 << rnd.randrange(64)
            fps.add(v)
    fps = sorted(fps)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(fps)]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "id bigint, fp bigint")).collect()
    got, want = Union(), Union()
    for a, b in links:
        got.join(a, b)
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                want.join(i, j)
    assert [got.find(i) for i in range(len(fps))] == [want.find(i) for i in range(len(fps))]


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "x"), (3, None, "x"), (4, " ", "x")], "doc_id bigint, text string, fp string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (None, None), (3, 3), (4, 3)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# Line dedup


def plain_lines(rows, num=4, den=5, least=1):
    """Numbers of lines that go, by comparing each line with all earlier ones."""
    seen, gone = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for number, line in enumerate((text or "").split("\n")):
            words = set(line.lower().split())
            if len(words) >= least:
                if any(len(words & s) * den >= num * len(words | s) for s in seen):
                    gone.setdefault(doc, set()).add(number)
                seen.append(words)
    return gone


def near_lines(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(90)] + ["the", "of", "and"] * 10
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 25))) for _ in range(n)]
    for _ in range(n):
        parts = rnd.choice(lines).split()
        for _ in range(rnd.randrange(4)):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        rnd.shuffle(parts)
        lines.append(" ".join(parts).upper() if rnd.random() < 0.2 else " ".join(parts))
    rnd.shuffle(lines)
    return ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]


@pytest.mark.parametrize("p", [line_dedup.Params(), line_dedup.Params(share=6, first_candidates=1, slots=64)])
def test_lines_equal_brute_force(spark, p):
    texts = near_lines(200)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, texts), p).collect()}
    gone = plain_lines(list(enumerate(texts)))
    for i, text in enumerate(texts):
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ()))
        assert got[i]["n_removed"] == len(gone.get(i, ()))


def test_lines_odd_rows(spark):
    line = "one two three four five six"
    rows = [(1, line, "a"), (1, line, "b"), (2, line + "\nshort line\n", "c"), (None, None, "d"), (4, "", "e"), (5, "short line", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect() if r["text"] is not None)
    assert got == [(1, line, 1, 0), (1, line, 1, 0), (2, "short line\n", 3, 1), (4, "", 1, 0), (5, "", 1, 1)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# Embeddings


def vectors_of(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    for i in range(0, n, 4):
        x[i] = x[i - 1] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])
    rows = [(i, x[i].astype(np.float32).tolist(), int(i % 2)) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0] * 15 + [None], 0), (n + 4, rows[5][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, rows[6][1], 0), (n + 6, rows[6][1], 0)]
    return spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int"), rows


def test_embedding_links(spark):
    df, rows = vectors_of(spark)
    got = embedding_dedup.near_duplicates(df).toPandas()
    x = np.stack([r[1] for r in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = np.array([[a[2] == b[2] for b in rows] for a in rows])
    want = int(((x @ x.T >= 0.93) & same).sum() - len(rows))
    found = int(got[got.vec_id < len(rows)].n_links.sum())
    assert want * 0.9 <= found <= want + 8  # 6 and what it links with also link with both rows of n + 6
    odd = got[(got.vec_id >= len(rows)) & (got.vec_id < len(rows) + 6)]
    assert (odd.n_links == 0).all() and (odd.component_id == odd.vec_id).all() and odd.kept.all()
    assert (got[got.vec_id == len(rows) + 6].component_id == 6).all()
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_at_the_threshold(spark):
    """Pairs at a cosine just over 0.93 and many pivots, two vector lengths, a rare one."""
    rng = np.random.default_rng(6)
    rows = []
    for length, n in ((24, 1200), (6, 300), (3, 4)):
        x = rng.standard_normal((n, length))
        x /= np.linalg.norm(x, axis=1)[:, None]
        g = rng.standard_normal((n // 2, length))
        g -= (g * x[: n // 2]).sum(axis=1)[:, None] * x[: n // 2]
        g /= np.linalg.norm(g, axis=1)[:, None]
        x[n // 2 :] = 0.931 * x[: n // 2] + (1 - 0.931**2) ** 0.5 * g
        rows += [(len(rows) + i, v.tolist(), float(i % 3 == 3)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label double")
    links = {}
    for a, u, _ in rows:
        links[a] = 0
    for length in (24, 6, 3):
        ids = [i for i, v, _ in rows if len(v) == length]
        x = np.array([rows[i][1] for i in ids])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, n in zip(ids, ((x @ x.T >= 0.93).sum(axis=1) - 1).tolist()):
            links[i] = n
    for n_pivots in (None, 512):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, n_pivots=n_pivots).collect()}
        assert got.keys() == links.keys() and all(got[i] <= links[i] for i in got)
        assert sum(got.values()) >= 0.97 * sum(links.values()) > 1500


def test_embedding_shares_count_alike(spark, monkeypatch):
    df, _ = vectors_of(spark)
    want = sorted(embedding_dedup.near_duplicates(df).collect())
    monkeypatch.setattr(embedding_dedup, "SHARE", 7)
    assert sorted(embedding_dedup.near_duplicates(df).collect()) == want


def plain_neighbours(rows, k=10):
    """The k nearest other ids of each id divisible by 10, by comparing all rows of one length."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q in {i for i, _ in good if i % 10 == 0}:
        best = {}
        for own in [v for i, v in good if i == q]:
            for i, v in good:
                if i != q and len(v) == len(own):
                    d = float(np.sqrt(((v - own) ** 2).sum()))
                    best[i] = min(best.get(i, d), d)
        out[q] = [(i, d) for d, i in sorted((d, i) for i, d in best.items())[:k]]
    return out


def neighbours(spark, rows, p=ann.Params()):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = {}
    for r in sorted(ann.search(df, df.where("vec_id % 10 = 0"), p).collect()):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_ann_ties_repeated_rows_and_lengths(spark):
    """Ties, repeated queries, one id with two vectors and rare lengths, against all pairs."""
    eye = np.eye(200)
    rows = [(i + 1, eye[i].tolist()) for i in range(200)] + [(100, eye[99].tolist())] * 2 + [(50, eye[3].tolist())]
    rows += [(1000 + i, [1.0 + i, 2.0, float(i % 3)]) for i in range(30)] + [(1010, [9.0, 9.0, 9.0]), (2000, [1.0, 1.0]), (2001, [1.0, 2.0]), (None, [1.0, 3.0]), (2010, [0.0, 0.0])]
    want = plain_neighbours(rows)
    got = neighbours(spark, rows)
    assert got.keys() == want.keys() and 2010 not in got
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in want[q]], rel=1e-12)


def test_ann_recall_where_the_ratio_decides(spark):
    """Many lists, of which each query looks into few."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 12))
    x = centres[rng.integers(60, size=4000)] + 0.35 * rng.standard_normal((4000, 12))
    rows = [(i, x[i].tolist()) for i in range(4000)]
    p = ann.Params(list_size=20, together=2, ratio=1.3)
    index = ann.Index([np.array(v) for _, v in rows], 4000, p)
    looked = np.mean([len(index.route(x[i], p)) for i in range(0, 4000, 10)])
    assert len(index.graphs[12][1].c) > 150 and looked < 30
    want, got = plain_neighbours(rows), neighbours(spark, rows, p)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ann_small_tables(spark):
    df, _ = vectors_of(spark, 100)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 5")
    assert ann.search(few, few).count() == 20


# Mixing


def test_mix_targets(spark):
    rnd = random.Random(9)
    texts = [" ".join(["w"] * rnd.randrange(1, 60)) for _ in range(600)] + [None, ""]
    sources = [rnd.choice(["a", "b", "b", "b", "c", None]) for _ in texts]
    docs = docs_of(spark, texts, sources)
    got = mixing.mix_sizes(docs).toPandas()
    again = mixing.mix_sizes(docs.repartition(5)).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist())) and len(got) == 602
    total = got["size"].sum()
    per = got.assign(source=got.source.fillna("~")).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert abs(per.target.sum() - 1.5 * total) < 1e-6 * total
    assert ((per.taken - per.target).abs() <= 60).all() and (per.target <= 2 * per["size"] + 1e-9).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()
    open_ = per[per.target < 2 * per["size"] - 1e-9]
    weights = dict(zip(sorted(per.index), (5, 2, 1, 5)))
    shares = [r.target / weights[s] for s, r in open_.iterrows()]
    assert max(shares) - min(shares) < 1e-6 * max(shares)
    assert mixing.mix_sizes(docs.limit(0)).count() == 0
    rows = [(None, "two words", "en", "s", 9)] * 200 + [(None, "two more", "en", "s", 9)] * 50 + [(5, "a b c", "en", "t", 5)] * 100 + [(6, "", "en", "t", 0), (7, None, None, None, None)]
    odd = spark.createDataFrame(rows, DOCS)
    whole, sizes = mixing.mix(odd).toPandas(), mixing.mix_sizes(odd).toPandas()
    for name in ("s", "t"):
        a, b = whole[whole.row.map(lambda r: r.source == name)], sizes[sizes.source == name]
        assert a.taken.sum() == b.taken.sum() and abs(a.taken.sum() - a.target.iloc[0]) <= 3 and len(a) == len(b)
    assert (whole.copies <= 2).all() and len(whole) == len(rows)
    full = mixing.mix(docs.withColumn("size", F.lit("clash")))
    assert full.count() == 602 and full.select("row.size").first()[0] == "clash"


# HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("plain &amp; <b>bold</b>", "plain & bold"),
        ("<article><h1>T</h1><p>a  b\n c<p>d &eacute;&#33;<ul><li>x<li>y</ul></article><footer>f</footer>", "T\na b c\nd é!\nx\ny"),
        ("<nav><a href=a>m</a></nav><div class='ad'>buy</div><main><p>one two three</p><aside>s</aside></main><script>var a='</p>';</script>", "one two three"),
        ("<article><p>body text here</p><section class=comments><p>I agree</p></section><form><p>q</p></form></article>", "body text here"),
        ("<div id=cookie-notice><p>cookies</p></div><article><p>kept &am", "kept &am"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_pages_query(spark):
    """On the article pages the result is the article element, read by plain patterns."""
    from html import unescape

    got = {r["page_id"]: r for r in queries.op6_html_density(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li)\b[^>]*>", re.sub(r"<[^>]*$", "", body))
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
        want = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


# Chat


def test_quotes(spark):
    a = "We should meet on Friday at noon near the old bridge."
    b = "Friday is fine, but let us say one o'clock instead."
    rows = [
        (1, 0, "user", a),
        (1, 1, "assistant", f"> We should meet on Friday at noon\n> near the old BRIDGE.\n\n{b}"),
        (1, 2, "user", f">> {a}\n> {b}\nAgreed."),
        (1, 3, "user", "A new matter altogether, with no quotation."),
        (1, 4, "user", f"> {a}\nNo, I cannot."),
        (2, 0, "user", f"> {a}\nQuoted from elsewhere."),
        (None, 0, "user", f"> {a}"),
        (3, None, "user", None),
        (4, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.build_conversations(df).collect()}
    assert len(got) == len(rows)
    tree = {k: (r["reply_to"], r["thread_turn"], r["depth"], r["max_level"]) for k, r in got.items() if k[0] == 1}
    assert tree == {(1, 0): (None, 0, 0, 0), (1, 1): (0, 0, 1, 1), (1, 2): (1, 0, 2, 2), (1, 3): (None, 3, 0, 0), (1, 4): (0, 0, 1, 1)}
    assert got[1, 1]["text"] == b and got[1, 2]["text"] == "Agreed." and got[1, 3]["text"] == rows[3][3]
    assert got[2, 0]["reply_to"] is None and got[2, 0]["n_quoted"] == 1
    assert got[3, None]["text"] is None and got[4, 0]["text"] == ""


def test_chat_query_without_quotes_changes_nothing(spark):
    got = {(r["conv_id"], r["turn"], r["role"], r["text"]) for r in queries.op1_chat_quotes(spark, SF).collect()}
    assert got == {tuple(r) for r in table(spark, SF, "conversations").collect()}


def test_chat_threads_in_a_long_chain(spark):
    text = [f"This is message number {i} of a chain, told apart by its words w{i * 7}." for i in range(40)]
    rows = [(9, i, "u", (f"> {text[i - 1]}\n" if i else "") + text[i]) for i in range(40)]
    got = chat.build_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert all(r["depth"] == r["turn"] and r["thread_turn"] == 0 for r in got)


# Classifiers


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_weak_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert len(got) > 300
    assert (got.keep == (got.quality == 1)).mean() >= 0.93
    assert got[got.quality == 1].keep.mean() >= 0.95
    docs = docs_of(spark, [None, "", " ", "x"]).withColumn("score", F.lit("clash"))
    assert quality.classify(docs).count() == 4 and quality.classify(docs.limit(0)).count() == 0


def test_vote_model_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85, 0.75, 0.9, 0.65])
    right = rng.random((len(truth), 9)) < accuracy
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    codes, counts = np.unique(((votes + 1) * 3 ** np.arange(8, -1, -1)).sum(axis=1), return_counts=True)
    post, found, prior = quality.fit_votes(codes, counts.astype(float))
    assert abs(prior - 0.7) < 0.03 and np.abs(found.mean(axis=1) - accuracy).max() < 0.04


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs.join(F.broadcast(labels), "doc_id").where(toxicity.in_fold()), model).toPandas()
    assert ((held.toxicity >= 0.5) == (held.toxic == 1)).mean() >= 0.93
    plain = held[held.text.str.contains("idiot|moron|worthless|scum")]
    assert (plain.toxicity >= 0.5).mean() >= 0.9
    odd = docs_of(spark, [None, "", " \n", "idiot " * 3000]).withColumn("toxicity", F.lit("clash"))
    scores = [r["toxicity"] for r in toxicity.score(odd, model).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] == scores[2] < 0.5 < scores[3]


def test_toxicity_folds_and_lone_class(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id bigint")
    for r in ids.select("doc_id", toxicity.in_fold().alias("held")).collect():
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, ["a", "b", "c"])
    assert {r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    assert {r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_gradients_by_differences():
    p = toxicity.Params(window=6, stride=4, hidden=3, word_dim=3, char_dim=2, start_dim=2, trigrams=32, starts=32)
    net = toxicity.Network(p, 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs = toxicity.Inputs(["good", "bad", "day", "x"], p)
    docs = [["good", "day", "bad"], ["bad", "bad", "unknown", "x", "day"], []]
    wins = [toxicity.window_ids(len(d), 6, 4)[0] for d in docs]
    y, weight = np.array([0.0, 1.0, 0.0]), np.ones(3)

    def loss():
        ids, made = toxicity._rows_of(net, inputs, docs, wins)
        proj = net.project(made[0])
        z = net.logits(proj, ids)
        q = toxicity.sigmoid(z)
        return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())

    ids, made = toxicity._rows_of(net, inputs, docs, wins)
    g = net.gradients(made, ids, y, weight)
    for name in net.w:
        flat = net.w[name].reshape(-1)
        for k in np.argsort(-np.abs(g[name].reshape(-1)))[:2]:
            was, step = flat[k], 1e-3
            flat[k] = was + step
            up = loss()
            flat[k] = was - step
            down = loss()
            flat[k] = was
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[k]) < 2e-3, name
