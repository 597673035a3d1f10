"""Spools, manifests and exports round trip."""

import json
import random

import duckdb
import pyarrow as pa
import pytest
from compare import differences
from corpusloom.arrowmap import BATCH_CONF
from corpusloom.operators import boolean_text, queues, versions
from corpusloom.plans import registry, spools
from corpusloom.sources import spool
from pyspark.sql import functions as F


def test_spool_parts_good_and_bad(spark, tmp_path):
    good = {"source": "s", "external_id": "1", "text": "body", "dates": {"publication": "2024-01-01"}}
    lines = [json.dumps(good), "{broken", json.dumps(good | {"text": " "}), json.dumps(good | {"source": ""}), json.dumps({**good, "external_id": None})]
    (tmp_path / "spool.jsonl").write_text("\n".join(lines))
    ok, bad = spool.read_spool(spark, str(tmp_path / "spool.jsonl"))
    assert [r["external_id"] for r in ok.collect()] == ["1"]
    assert sorted(r["reason"] for r in bad.collect()) == ["NOT_JSON", "NO_ID", "NO_SOURCE", "NO_TEXT"]


def test_documents_and_manifest(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"d{i}.json").write_text(json.dumps({"source": "s", "external_id": str(i), "text": f"t{i}"}, indent=1))
    assert spool.read_documents(spark, str(tmp_path)).count() == 3
    m = spool.manifest(spark.read.format("binaryFile").load(str(tmp_path / "*.json")))
    assert m.where("length(sha256) = 64").count() == 3


def test_insert_and_resync(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "old"), (4, "w")], "k int, v string")
    assert [r["k"] for r in spool.insert_new(a, b, ["k"]).collect()] == [1]
    states = {r["k"]: r["state"] for r in spool.resync(a.distinct(), b, ["k"], "v").collect()}
    assert states == {1: "added", 2: "same", 3: "changed", 4: "removed"}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, '=sum("a")'), (2, None)], "k int, v string")
    spool.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    lines = sorted(x for p in (tmp_path / "csv").glob("part-*") for x in p.read_text().splitlines())
    assert lines == ['"1","\'=sum(""a"")"', '"2",""']
    assert spool.markdown_table(df, ["k"]).first()[0].endswith('| 1 | =sum("a") |\n| 2 |  |')
    long = spark.createDataFrame([(1, "2024-02-03", "w" * 200)], "k int, d string, t string").withColumn("d", F.to_date("d"))
    event = spool.calendar_feed(long, "k", "d", "t").first()[0].split("\r\n")
    assert max(map(len, event)) <= 75 and "".join(x.strip() for x in event if "w" in x) == "SUMMARY:" + "w" * 200


def test_ocr(spark):
    head = "5\t{}\t1\t1\t1\t{}\t0\t0\t1\t1\t{}\t{}"
    rows = [(head.format(1, 2, 80, "b"),), (head.format(1, 1, 90, "a"),), (head.format(2, 1, -1, ""),)]
    got = spool.ocr_words(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["page"], r["text"], r["confidence"]) for r in got] == [(1, "a b", 85.0)]


def test_ocr_pages_are_put_together_where_they_are_read(spark):
    """One row a run of a page leaves a batch, and pages in pieces equal a plain version, in any order."""
    line = lambda page, conf, word, *at: "\t".join(map(str, (5, page, *at, 0, 0, 0, 0, conf, word)))
    got = spool.page_pieces(pa.array([line(1, 90, "b", 1, 1, 1, 2), line(1, 80, "a", 1, 1, 1, 1), line(1, 10, "x", 1, 1, 1, 3), line(2, 60, "c d", 1, 1, 1, 1), None]), 50.0, True)
    assert got.select(["page", "n", "total", "words"]).to_pylist() == [{"page": 1, "n": 2, "total": 170.0, "words": "a\tb"}, {"page": 2, "n": 1, "total": 60.0, "words": "c d"}]
    rnd = random.Random(7)
    held = [(rnd.randrange(9), rnd.choice([49, 50, 51.5, " 80"]), rnd.choice(["a", "b c", " d", "é", "ü\U0001f600", "\ufffd", " "]), *[rnd.randrange(3) for _ in range(4)]) for _ in range(900)]
    want = {}
    for page, conf, word, *at in held:
        if float(conf) >= 50 and word.strip():
            want.setdefault(page, []).append((at, word.encode(), float(conf)))
    rows = spark.createDataFrame([(line(*h),) for h in held], "value string").repartition(5)
    before = spark.conf.get(BATCH_CONF)
    for most in (7, 2000):
        spark.conf.set(BATCH_CONF, most)
        read = {r["page"]: (r["text"], round(r["confidence"], 6)) for r in spool.ocr_words(rows, 50.0).collect()}
        assert read == {p: (" ".join(w.decode() for _, w, _ in sorted(v)), round(sum(c for *_, c in v) / len(v), 6)) for p, v in want.items()}
    spark.conf.set(BATCH_CONF, before)


def test_ocr_rows_that_do_not_parse(spark):
    """They fail, as Spark's casts do; without ANSI they are left out, and a page without a number is one of its own."""
    bad = spark.createDataFrame([("level\tpage\tb\tp\tl\tw\tx\ty\tw\th\tconf\ttext",), ("5\t1",), ("5\tx\t1\t1\t1\t1\t0\t0\t0\t0\t70\ta",)], "value string")
    with pytest.raises(Exception):
        spool.ocr_words(bad).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert [tuple(r) for r in spool.ocr_words(bad).collect()] == [(None, "a", 70.0)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_ocr_spool_is_packed(spark):
    """The rows of the words take less than half of their text on disk, and are all there."""
    rows = spark.range(20000).select(F.concat_ws("\t", F.lit("5"), "id", F.lit("1\t0\t0\t0\t0\t0\t0\t0\t90\tword")).alias("value"))
    path = spools.written(rows, **spools.PACKED)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    assert size * 2 < rows.agg(F.sum(F.length("value") + 1)).first()[0]
    assert spark.read.text(path).exceptAll(rows).count() == 0 and spark.read.text(path).count() == 20000


def test_range_join_equals_plain(spark):
    left = [(i, i * 7 % 40, i * 7 % 40 + i % 9) for i in range(60)]
    right = [(i, i * 11 % 40, i * 11 % 40 + i % 13) for i in range(60)]
    a, b = spark.createDataFrame(left, "a int, lo int, hi int"), spark.createDataFrame(right, "b int, q_lo int, q_hi int")
    got = {(r["a"], r["b"]) for r in versions.range_join(a, b, ("lo", "hi"), ("q_lo", "q_hi"), 5).collect()}
    assert got == {(x[0], y[0]) for x in left for y in right if x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]}


def test_boolean_text(spark):
    df = spark.createDataFrame([(1, "red fox and RED hen"), (2, "a fox"), (3, "the red fox ran")], "k int, text string")
    assert {r["k"]: r["score"] for r in boolean_text.search(df, [("AND", "red fox", 2), ("NOT", "RAN", 1)]).collect()} == {1: 2}
    assert {r["k"] for r in boolean_text.search(df, [("AND", "hen", 1), ("OR", "ran", 1)]).collect()} == {1, 3}
    assert boolean_text.search(df, []).count() == 0


def test_backoff_doubles(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "job_id int, attempts int").withColumns({"state": F.lit("running"), "available_at": now})
    got = {r["job_id"]: (r["state"], r["wait"]) for r in queues.fail(df, F.lit(True), now, 3, 30).withColumn("wait", F.unix_seconds("available_at") - F.unix_seconds(now)).collect()}
    assert got == {1: ("queued", 30), 2: ("queued", 60), 3: ("dead", 0)}


def test_quotes_of_any_length(spark):
    """Long quotes, and short ones inside words, against plain containment."""
    from corpusloom.operators.evidence import containing

    texts = ["one two three four five six seven", "xone two", "seven six", "", None, "öne tw o", "a"]
    quotes = ["one two three four five six", "two three four five six seven", "ne tw", "six", "e", "ö", "zz", "", None, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id int, text string")
    got = sorted(tuple(r) for r in containing(docs, asked).collect())
    assert got == sorted((i, k, t.index(q)) for i, t in enumerate(texts) for k, q in enumerate(quotes) if t and q and q in t)


def test_components(spark):
    from corpusloom.graph import connected_components

    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (159, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 100 and got[199] == got[200] == 199
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_spool_of_odd_documents_equals_its_sql(spark, tmp_path):
    """Documents without text or id, with a blank or a very long text, are captured like others."""
    texts = [None, "", "  ", "\u00a0", "captured", "captured\n", "a\x00b\r\n\u2028\"\\"]
    rows = [(i, texts[i % len(texts)]) for i in range(-150, 150)] + [(None, None), (None, ""), (None, "a"), (2, "x"), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("bigint")})
    long = spark.range(1).select(F.lit(1).cast("bigint").alias("doc_id"), F.repeat(F.lit("x"), 20_000_001).alias("text"), F.lit("en").alias("lang"), F.lit(20_000_001).cast("bigint").alias("n_chars"))
    docs.union(long).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("src_library_spool", "src_jsonl"):
        assert differences(spark, con, str(tmp_path), name, getattr(spools, name), registry.oracle_sql()[name]) is None
