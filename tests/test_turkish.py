"""Stems, packing and matching against plain versions on own cases."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import turkish
from corpusloom.operators import articles, authority, packing, versions
from corpusloom.plans import turkish as plans


def plain_stem(word):
    for k in range(3):
        if word in turkish.STOP_STEMS:
            break
        for end in sorted(turkish.INFLECTIONS, key=len, reverse=True) + list(turkish.BARE_VOWELS):
            bare = end in turkish.BARE_VOWELS
            if word.endswith(end) and not (bare and k) and len(word) - len(end) >= (4 if bare else 3):
                word = word[: -len(end)]
                break
        else:
            break
    return word[:-1] + word[-1].translate(str.maketrans(turkish.SOFT, turkish.HARD))


def test_stems(spark):
    rnd = random.Random(2)
    roots = "sözleşme araç temerrüt karar kira madde ev kitap tazminat dava ağaç renk".split()
    words = roots + ["".join([rnd.choice(roots), *(rnd.choice(turkish.INFLECTIONS + list(turkish.BARE_VOWELS)) for _ in range(rnd.randrange(4)))]) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("s", turkish.stem(F.col("w")))
    assert {r["w"]: r["s"] for r in df.collect()} == {w: plain_stem(w) for w in words}
    known = {"sözleşmesinde": "sözleşme", "aracı": "araç", "araç": "araç", "kira": "kira", "maddesinin": "madde", "edilmiş": plain_stem("edilmiş")}
    df = spark.createDataFrame(list(known.items()), "w string, want string").select(turkish.stem(F.col("w")).alias("s"), "want")
    assert all(r["s"] == r["want"] for r in df.collect())
    pairs = [("belirlen", "belirle", True), ("kar", "kara", False), ("karar", "karat", True), ("ev", "ev", True), ("dolandırıcı", "dolandır", True), ("dolanma", "dolandır", True), ("dolap", "dolandır", True), ("dolmuş", "dolandır", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("got", turkish.same_lexeme(F.col("a"), F.col("b")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_units_and_chunks(spark):
    rnd = random.Random(4)
    for _ in range(200):
        at, spans = 0, []
        for _ in range(rnd.randrange(1, 30)):
            at += rnd.randrange(5)
            spans.append((at, at + rnd.randrange(1, 60)))
            at = spans[-1][1]
        units = packing.unit_numbers(spans, 60, 100)
        assert units == sorted(units) and units[0] == 1 and set(units) == set(range(1, units[-1] + 1))
        for u in set(units):
            own = [s for s, n in zip(spans, units, strict=True) if n == u]
            assert len(own) == 1 or own[-1][1] - own[0][0] <= 100
            assert len(own) < 2 or len(own) == 2 or own[-2][1] - own[0][0] < 60
    text = "Av. Ali geldi. " + " ".join(f"Cümle {i} burada biter." for i in range(40)) + " Son"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = [r["chunk"] for r in packing.overlap_chunks(docs, "doc_id", size=200, overlap=40, least=1).orderBy("ordinal").collect()]
    assert got[0].startswith("Av. Ali geldi Cümle 0") and got[-1].endswith("Son") and all(len(c) < 260 for c in got)
    for i in range(40):
        assert any(f"Cümle {i} " in c for c in got)


def plain_chunks(lengths, size, overlap):
    """Chunks by walking the sentences."""
    chunks, held = [], []
    for i, n in enumerate(lengths):
        if held and sum(lengths[j] for j in held) + n > size:
            chunks.append(held)
            back = next((k for k in range(1, len(held) + 1) if sum(lengths[j] for j in held[-k:]) >= overlap), len(held))
            held = held[-back:]
        held = [*held, i]
    return [(c[0], c[-1]) for c in [*chunks, held] if c]


def test_chunk_spans_equal_plain():
    rnd = random.Random(6)
    for _ in range(500):
        lengths = [rnd.randrange(1, rnd.choice([5, 40])) for _ in range(rnd.randrange(30))]
        size, overlap = rnd.randrange(1, 60), rnd.randrange(0, 30)
        assert packing.chunk_spans(np.array(lengths, int), size, overlap) == plain_chunks(lengths, size, overlap)


def test_sentences(spark):
    text = "Yarg. 9. HD kararı m. 14 uyarınca verildi. Bedel 10.000 TL. Ödendi! A.Ş. bildirdi; sonra 2019. Yeni\n\nSon"
    docs = spark.createDataFrame([(text,), (None,)], "t string").select(packing.sentences("t").alias("s")).collect()
    assert docs[0]["s"] == ["Yarg. 9. HD kararı m. 14 uyarınca verildi.", "Bedel 10.000 TL.", "Ödendi!", "A.Ş. bildirdi;", "sonra 2019.", "Yeni", "Son"] and docs[1]["s"] == [""]
    rows = [("türk ceza kanunu", "ceza kanunu"), ("a", None), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(packing.sequence_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows]


def test_matching_equals_all_assignments():
    rnd = random.Random(8)
    assert packing.matched([[i, i + 1] for i in range(3000)] + [[0]], 3001) == 3001
    for _ in range(200):
        wanted = [[j for j in range(4) if rnd.random() < 0.4] for _ in range(4)]
        best = max(sum(j in wanted[i] for i, j in enumerate(p)) for p in itertools.permutations(range(4)))
        assert packing.matched(wanted, 4) == best


def test_versions_of_one_day_stay_open(spark):
    rows = [(1, 1, "2020-01-01", None), (1, 2, "2020-01-01", None), (1, 3, "2021-01-01", None), (1, 4, "2019-01-01", "2019-06-01"), (2, 5, "2020-01-01", None)]
    df = spark.createDataFrame(rows, "document_id int, version_id int, valid_from string, valid_to string").select("document_id", "version_id", F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"))
    got = {r["version_id"]: str(r["valid_to"]) for r in versions.close_previous(df).collect()}
    assert got == {1: "2021-01-01", 2: "2021-01-01", 3: "None", 4: "2019-06-01", 5: "None"}


def plain_search(content, terms, without, every, around):
    """Hits, terms held and preview by scanning for each term."""
    low = content.lower()
    found = {t: [] for t in terms}
    for t in terms:
        at = low.find(t)
        while at >= 0:
            found[t].append(at)
            at = low.find(t, at + len(t))
    held = [bool(v) for v in found.values()]
    if not (all(held) if every else any(held)) or any(t in low for t in without):
        return None
    start, end = min((a, a + len(t)) for t, v in found.items() for a in v)
    a, b = max(0, start - around), min(len(content), end + around)
    return sum(map(len, found.values())), sum(held), ("..." if a else "") + content[a:b] + ("..." if b < len(content) else "")


def test_article_search_equals_plain(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["Kira", "kira ", "bedel", "é🙂", " a.b", "x", "depozito"]) for _ in range(rnd.randrange(1, 25))) for _ in range(80)]
    df = spark.createDataFrame([(i % 7, i, str(i), t) for i, t in enumerate(texts)], "id int, ordinal int, article string, content string")
    for terms, without, every in ((["kira"], [], True), (["kira", "bedel"], ["depozito"], True), (["a.b", "bedel"], [], False)):
        got = {r["ordinal"]: (r["hits"], r["n_terms"], r["preview"], r["rank"], r["id"]) for r in articles.search(df, "id", terms, without, every, 6).collect()}
        want = {i: p for i, t in enumerate(texts) if (p := plain_search(t, terms, without, every, 6))}
        assert {i: g[:3] for i, g in got.items()} == want
        for k in range(7):
            order = sorted((i for i, g in got.items() if g[4] == k), key=lambda i: (-got[i][1], -got[i][0], i))
            assert [got[i][3] for i in order] == list(range(1, len(order) + 1))


def test_lexeme_counts_make_no_pairs(spark):
    """Counts equal those of all pairs, also where thousands of stems share their start."""
    rnd = random.Random(9)
    stems = sorted({rnd.choice(["kara", "karb", "yaz"]) + "".join(rnd.choice("abç") for _ in range(rnd.randrange(9))) for _ in range(500)})
    pairs = [(a, b) for a, b in itertools.combinations([s for s in stems if len(s) >= 4], 2) if a[:4] == b[:4]]
    need = lambda a, b: max(4, -(-7 * min(len(a), len(b)) // 10))
    want = {}
    for a, b in pairs:
        same, near = want.get(a, (0, 0))
        want[a] = (same + (a[: need(a, b)] == b[: need(a, b)]), near + 1)
    got = turkish.lexeme_counts(spark.createDataFrame([(s,) for s in stems], "s string"), "s").collect()
    assert {r["s"]: (r["n_same"], r["n_near"]) for r in got} == want
    many = spark.range(100_000).select(F.concat(F.lit("karar"), F.col("id").cast("string")).alias("s"))
    assert turkish.lexeme_counts(many, "s").agg(F.sum("n_near")).first()[0] == 100_000 * 99_999 // 2


def test_ratios_of_equal_names_make_no_pairs(spark):
    rows = [(k, f"{'red' if k % 3 else 'blue'} {'ring' if k % 5 else 'gear'}", "A" if k % 7 else "B") for k in range(300)] + [(300, None, "A"), (None, "red ring", "A"), (301, "red cog", None)]
    p = spark.createDataFrame(rows, "k int, n string, b string")
    got = packing.name_ratios(p, "k", "n", F.substring_index("n", " ", 1), "b").collect()
    member = {r["other"]: r["k"] for r in got if r["link"] == "member"}
    ratios = {(r["k"], r["other"]): r["ratio"] for r in got if r["link"] == "names"}
    assert len(got) < 310 and len(member) + 8 == 300
    whole = [r for r in rows if None not in r]
    for (i, x, a), (j, y, b) in itertools.combinations(whole, 2):
        u, v = member.get(i, i), member.get(j, j)
        if x.split()[0] == y.split()[0] and a == b:
            assert SequenceMatcher(None, x, y).ratio() == (1.0 if u == v else ratios[u, v])
        else:
            assert (u, v) not in ratios and u != v


def test_matching_has_no_call_a_case(spark):
    """Most pairs of each case equal brute force; cases go to Python in batches, not one by one."""
    rnd = random.Random(12)
    rows = sorted({(c, rnd.randrange(4), rnd.randrange(4)) for c in range(60) for _ in range(rnd.randrange(1, 9))})
    found = packing.match_items(spark.createDataFrame([(*r, 0.5) for r in rows], "c int, gold int, found int, iou double"), "c")

    def most(pairs):
        return max(k for k in range(len(pairs) + 1) for some in itertools.combinations(pairs, k) if len({g for _, g, _ in some}) == k == len({f for *_, f in some}))

    want = {c: most([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r["c"]: r["matched"] for r in found.collect()} == want
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_stem_sets_are_made_where_texts_are_read(spark):
    """Words meet no table of stems, and no filter above has them stemmed again for each use."""
    plan = plans.fn_stem_set(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count(turkish.BACKWARDS) == 1


def test_stance_reads_its_text_once(spark):
    rows = spark.createDataFrame([("Karar", "Davanın REDDİNE ve kabulüne"), ("Kanun", "beraat"), (None, None), ("karar", "kabulüne")], "kind string, text string")
    found = rows.select(authority.stance(F.col("kind"), F.col("text")).alias("s"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    assert [r["s"] for r in found.collect()] == ["contrary", "neutral", "neutral", "supporting"]
