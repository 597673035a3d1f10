"""Queries for ingestion, retrieval, evidence, analysis, metrics and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, vectors
from corpusloom.operators import analysis, evidence, queues, references, retrieval, versions
from corpusloom.plans.registry import query
from corpusloom.plans.relational import LANES_SQL, PAIRS_SQL, VERSIONS_SQL, lanes
from corpusloom.plans.scalars import BLANKS, TR_LOWER
from corpusloom.tables import table

CHUNKS_SQL = """lines as (select doc_id, unnest(string_split(text, chr(10))) as body, unnest(range(0, len(string_split(text, chr(10))))) as ordinal from documents),
chunks as (select doc_id, ordinal, body from lines where trim(body) <> '')"""
WORDS_SQL = r"list_distinct(list_filter(string_split_regex(lower(body), '[^\p{L}]+'), lambda x: length(x) >= 3))"
QUERY = "the license of this file with and"


# Ingestion


@query("ig_chunk_generic", f"with {CHUNKS_SQL} select doc_id, ordinal::int as ordinal, body, sha256(body) as chunk_sha256 from chunks")
def ig_chunk_generic(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.chunks(table(spark, d, "documents"))
    return c.select("doc_id", "ordinal", "body", F.sha2("body", 256).alias("chunk_sha256"))


@query("ig_chunk_validate", f"with {CHUNKS_SQL}, s as (select doc_id, ordinal, body, coalesce(sum(length(body) + 1) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as start from lines) select s.doc_id, count(*) as n, count(*) filter (where substring(d.text, s.start::int + 1, length(s.body)) = s.body) as n_exact from s join documents d using (doc_id) group by 1")
def ig_chunk_validate(spark: SparkSession, d: str) -> DataFrame:
    """Lines of texts whose place by the running sum of lengths is theirs.

    The lines put together again are compared with the whole text once; where they equal it,
    every line stands at its offset, so no line is looked up from the start of the text.
    """
    lines = F.split("text", "\n")
    n = F.size(lines).cast("long")
    whole = F.array_join(lines, "\n") == F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", n.alias("n"), F.when(whole, n).otherwise(0).cast("long").alias("n_exact"))


@query("ig_identity", "select source, lang, count(*) as n_versions, min(doc_id) as first_id from documents group by 1, 2")
def ig_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_versions"), F.min("doc_id").alias("first_id"))


@query(
    "ig_hash_lookup",
    """with stored as (select source as document_id, sha256(text) as h, bool_or(n_chars >= 500) as cur from documents where lang = 'en' group by 1, 2),
    incoming as (select doc_id, source as document_id, sha256(text) as h from documents)
    select i.doc_id, case when s.cur is null then 'new' when s.cur then 'unchanged' else 'reverted_content' end as action from incoming i left join stored s on s.document_id = i.document_id and s.h = i.h""",
)
def ig_hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All documents come in; those of one language are stored already."""
    t = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("document_id"), F.sha2("text", 256).alias("content_sha256"), (F.col("n_chars") >= 500).alias("is_current"))
    return versions.outcomes(t.drop("is_current"), t.where("lang = 'en'")).select("doc_id", "action")


@query("ig_close_effective", f"with {VERSIONS_SQL} select document_id, version_id, valid_from, valid_to from versions")
def ig_close_effective(spark: SparkSession, d: str) -> DataFrame:
    return versions.close_previous(versions.order_versions(table(spark, d, "orders"))).select("document_id", "version_id", "valid_from", "valid_to")


@query("ig_close_system", "select user_id, event_id, ts as sys_from, lead(ts) over (partition by user_id order by ts, event_id) as sys_to from events")
def ig_close_system(spark: SparkSession, d: str) -> DataFrame:
    to = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("sys_from"), to.alias("sys_to"))


@query("ig_append_version", "select doc_id, sha256(text) as content_sha256, row_number() over (partition by sha256(text) order by doc_id) = 1 as is_first from documents")
def ig_append_version(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("text", 256)
    rn = F.row_number().over(Window.partitionBy("content_sha256").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", h.alias("content_sha256")).withColumn("is_first", rn == 1)


@query("ig_publish", "select doc_id, case when length(trim(text)) > 0 then 'published' else 'parsed' end as status from documents")
def ig_publish(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(F.length(F.trim("text")) > 0, "published").otherwise("parsed").alias("status"))


@query("ig_outcomes", "with t as (select doc_id, count(*) over (partition by sha256(text)) as n from documents) select case when n > 1 then 'unchanged' else 'published' end as action, count(*) as n from t group by 1")
def ig_outcomes(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("rows"))
    action = F.when(F.col("rows") > 1, "unchanged").otherwise("published").alias("action")
    return per.select(action, "rows").groupBy("action").agg(F.sum("rows").alias("n"))


@query("ig_list_in_force", f"with {VERSIONS_SQL} select document_id, version_id, valid_from from versions where valid_from <= date '1995-01-01' and (valid_to is null or valid_to > date '1995-01-01')")
def ig_list_in_force(spark: SparkSession, d: str) -> DataFrame:
    v = versions.close_previous(versions.order_versions(table(spark, d, "orders")))
    return versions.in_force(v, "1995-01-01").select("document_id", "version_id", "valid_from")


@query("ig_currentness", f"with {VERSIONS_SQL} select version_id, case when valid_from > date '1996-01-01' then 'NOT_YET_IN_FORCE' when valid_to is null or valid_to > date '1996-01-01' then 'IN_FORCE' else 'OUT_OF_DATE' end as currentness, case when valid_from > date '1996-01-01' then 0.1::double when valid_to is null or valid_to > date '1996-01-01' then 1.0::double else 0.2::double end as score from versions")
def ig_currentness(spark: SparkSession, d: str) -> DataFrame:
    v = versions.close_previous(versions.order_versions(table(spark, d, "orders")))
    day = F.lit("1996-01-01").cast("date")
    early, held = F.col("valid_from") > day, F.col("valid_to").isNull() | (F.col("valid_to") > day)
    state = F.when(early, "NOT_YET_IN_FORCE").when(held, "IN_FORCE").otherwise("OUT_OF_DATE")
    return v.select("version_id", state.alias("currentness"), F.when(early, 0.1).when(held, 1.0).otherwise(0.2).alias("score"))


@query("ig_fingerprint", r"select doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\x0b\f]+', ' ', 'g'))) as fingerprint from documents")
def ig_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.functions.text import collapse

    return table(spark, d, "documents").select("doc_id", F.sha2(collapse(F.col("text")), 256).alias("fingerprint"))


@query("ig_staleness", "select a.doc_id, sha256(a.text) is distinct from sha256(b.text) as stale from documents a left join documents b on b.doc_id = a.doc_id + 1")
def ig_staleness(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    stored = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("stored"))
    return h.join(stored, "doc_id", "left").select("doc_id", (~F.col("h").eqNullSafe(F.col("stored"))).alias("stale"))


@query("ig_amendment_hints", "select event_id, json_extract_string(props, '$.k')::bigint as k from events where event_type = 'click'")
def ig_amendment_hints(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return table(spark, d, "events").where("event_type = 'click'").select("event_id", parsed["k"].alias("k"))


@query("ig_enqueue_embed", "select o_orderkey, p from orders, (values ('small'), ('large')) t(p) where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45 and p = 'small')")
def ig_enqueue_embed(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(F.lit("small"), F.lit("large"))).alias("p"))
    have = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("small").alias("p"))
    return wanted.join(have, ["o_orderkey", "p"], "left_anti")


@query("ig_segmented_canonical", "select conv_id, string_agg(trim(text), chr(10) || chr(10) order by turn) as canonical, sum(length(trim(text)))::bigint as n_chars from conversations group by 1")
def ig_segmented_canonical(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("body"))))
    joined = F.array_join(F.transform(blocks, lambda b: b["body"]), "\n\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(joined.alias("canonical"), F.sum(F.length(F.trim("text"))).cast("long").alias("n_chars"))


@query("ig_locator_for_range", "select l_orderkey, 's. ' || min(l_linenumber) || '-' || max(l_linenumber) as label from lineitem group by 1")
def ig_locator_for_range(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("s. "), F.min("l_linenumber").cast("string"), F.lit("-"), F.max("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(label.alias("label"))


@query("ig_watch_compare", "with a as (select o_custkey as k, count(*) as n from orders where o_orderdate < timestamp '1995-01-01' group by 1), b as (select o_custkey as k, count(*) as n from orders where o_orderdate >= timestamp '1995-01-01' group by 1) select coalesce(a.k, b.k) as k, case when a.k is null then 'baseline_stored' when b.k is null then 'gone' when a.n = b.n then 'unchanged' else 'maybe_changed' end as state from a full outer join b on a.k = b.k")
def ig_watch_compare(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    split = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    a = o.where(split).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("was"))
    b = o.where(~split).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("now"))
    state = F.when(F.col("was").isNull(), "baseline_stored").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "unchanged").otherwise("maybe_changed")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@query("snk_snapshot", "select min(doc_id) as doc_id, source, sha256(text) as raw_sha256 from documents group by source, sha256(text)")
def snk_snapshot(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("raw_sha256"))
    return t.groupBy("source", "raw_sha256").agg(F.min("doc_id").alias("doc_id"))


@query("snk_vector_upsert", "with u as (select vec_id % 400 as id, vec_id, label from embeddings) select id, max(vec_id) as vec_id, arg_max(label, vec_id) as label from u group by 1")
def snk_vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "embeddings").select((F.col("vec_id") % 400).alias("id"), "vec_id", "label")
    return u.groupBy("id").agg(F.max("vec_id").alias("vec_id"), F.max_by("label", "vec_id").alias("label"))


@query("snk_chunk_insert", f"with {CHUNKS_SQL} select sha256(body) as h, count(*) as n_seen, min(doc_id) as first_doc from chunks group by 1")
def snk_chunk_insert(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.chunks(table(spark, d, "documents"))
    return c.groupBy(F.sha2("body", 256).alias("h")).agg(F.count("*").alias("n_seen"), F.min("doc_id").alias("first_doc"))


@query("src_paged_document", "select conv_id, case when count(*) <= 6 then 'OK' else 'TOO_MANY_PAGES' end as status, case when count(*) <= 6 then string_agg(text, chr(10) order by turn) end as text from conversations group by 1")
def src_paged_document(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a document in order; one of over six pages is refused with a status."""
    pages = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(pages.alias("pages"))
    few = F.size("pages") <= 6
    status = F.when(few, "OK").otherwise("TOO_MANY_PAGES").alias("status")
    return g.select("conv_id", status, F.when(few, F.array_join(F.transform("pages", lambda x: x["text"]), "\n")).alias("text"))


# Retrieval

LEXICAL_SQL = f"""{CHUNKS_SQL}, posts as (select doc_id, ordinal, unnest({WORDS_SQL}) as word from chunks),
q(word) as (values ('the'), ('license'), ('this'), ('file'), ('with'), ('and')), n as (select count(*) as n from chunks),
df as (select q.word, count(p.word) as df from q left join posts p on p.word = q.word group by 1),
idf as (select word, ln(1 + (greatest(n, df) - df + 0.5::double) / (df + 0.5::double)) as idf from df, n),
cov as (select doc_id, ordinal, count(*) as matched, count(*) / 6.0::double as coverage, sum(idf) / (select sum(idf) from idf) as weighted_coverage from posts join idf using (word) group by 1, 2),
kept as (select * from cov where matched >= 2 or weighted_coverage >= 0.25)"""


@query("rt_lexical_coverage", f"with {LEXICAL_SQL} select doc_id, ordinal::int as ordinal, matched, round(coverage, 6) as coverage, round(weighted_coverage, 6) as weighted_coverage from kept")
def rt_lexical_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.lexical_coverage(spark, retrieval.chunks(table(spark, d, "documents")), QUERY)
    return c.withColumns({"coverage": F.round("coverage", 6), "weighted_coverage": F.round("weighted_coverage", 6)})


@query("wn_lexical_rank", f"with {LEXICAL_SQL} select doc_id, ordinal::int as ordinal, row_number() over (order by round(weighted_coverage, 9) desc, doc_id, ordinal)::int as rank from kept order by rank limit 50")
def wn_lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.lexical_coverage(spark, retrieval.chunks(table(spark, d, "documents")), QUERY)
    order = [F.desc("w"), F.asc("doc_id"), F.asc("ordinal")]
    top = c.withColumn("w", F.round("weighted_coverage", 9)).orderBy(*order).limit(50)
    return top.select("doc_id", "ordinal", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("rt_df_stats", f"with {CHUNKS_SQL}, posts as (select unnest({WORDS_SQL}) as word from chunks) select word, count(*) as df from posts group by 1")
def rt_df_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(retrieval.chunks(table(spark, d, "documents"))).groupBy("word").agg(F.count("*").alias("df"))


@query("ag_idf_sum", f"with {LEXICAL_SQL} select doc_id, round(sum(idf), 6) as idf, string_agg(distinct word, ',' order by word) as terms from posts join idf using (word) group by 1")
def ag_idf_sum(spark: SparkSession, d: str) -> DataFrame:
    words = retrieval.query_words(QUERY)
    wanted = spark.createDataFrame([(w,) for w in words], "word string")
    c = retrieval.chunks(table(spark, d, "documents"))
    hits = retrieval.postings(c).join(F.broadcast(wanted), "word")
    n = c.agg(F.count("*").alias("n"))
    idf = hits.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", vectors.bm25_idf(F.col("n"), F.col("df")).alias("idf"))
    terms = F.array_join(F.array_sort(F.collect_set("word")), ",")
    return hits.join(F.broadcast(idf), "word").groupBy("doc_id").agg(F.round(F.sum("idf"), 6).alias("idf"), terms.alias("terms"))


DENSE_SQL = "select b.vec_id as id, round(list_cosine_similarity(list_transform(b.embedding, lambda x: x::double), list_transform(a.embedding, lambda x: x::double)), 9) as score from embeddings a join embeddings b on a.vec_id = (select min(vec_id) from embeddings)"


def first_vector(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    """All vectors, and that of the smallest id as a query."""
    e = table(spark, d, "embeddings")
    return e, e.orderBy("vec_id").select("embedding").first()[0]


@query("rt_dense_exact", f"with s as ({DENSE_SQL}) select id, round(score, 6) as score, row_number() over (order by score desc, id)::int as rank from s order by rank limit 20")
def rt_dense_exact(spark: SparkSession, d: str) -> DataFrame:
    e, q = first_vector(spark, d)
    return retrieval.dense(e, q, 20).withColumn("score", F.round("score", 6))


@query("rt_vector_search", f"with s as ({DENSE_SQL}) select id from s where score >= 0.3 order by score desc, id limit 15")
def rt_vector_search(spark: SparkSession, d: str) -> DataFrame:
    e, q = first_vector(spark, d)
    return retrieval.dense(e, q, 15).where("score >= 0.3").select("id")


@query("rt_rrf_fuse", f"with {LANES_SQL} select coalesce(lex.id, sem.id) as id, round(coalesce(1.0::double / (60 + lex.rank), 0) + coalesce(0.7::double / (60 + sem.rank), 0), 9) as score from lex full outer join sem on lex.id = sem.id")
def rt_rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    a, b = lanes(spark, d)
    return retrieval.fuse([(a, 1.0), (b, 0.7)]).select("id", F.round("score", 9).alias("score"))


@query("rt_hybrid_sql", f"with {LANES_SQL}, f as (select coalesce(lex.id, sem.id) as id, coalesce(1.0::double / (60 + lex.rank), 0) + coalesce(1.0::double / (60 + sem.rank), 0) as score from lex full outer join sem on lex.id = sem.id) select id, round(score, 9) as score from f order by round(score, 12) desc, id limit 30")
def rt_hybrid_sql(spark: SparkSession, d: str) -> DataFrame:
    a, b = lanes(spark, d)
    f = retrieval.fuse([(a, 1.0), (b, 1.0)])
    return f.orderBy(F.round("score", 12).desc(), "id").limit(30).select("id", F.round("score", 9).alias("score"))


@query("rt_pins_first", f"with {LANES_SQL}, pins as (select p_partkey as id from part where p_size = 50) select coalesce(lex.id, pins.id) as id, pins.id is not null as pinned from lex full outer join pins on lex.id = pins.id")
def rt_pins_first(spark: SparkSession, d: str) -> DataFrame:
    a, _ = lanes(spark, d)
    pins = table(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("id"))
    return retrieval.pins_first(retrieval.fuse([(a, 1.0)]), pins).select("id", "pinned")


@query("rt_diversity_cap", "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 3")
def rt_diversity_cap(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return retrieval.cap_per_document(hits, "l_partkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).drop("l_extendedprice")


@query("rt_court_verdict", "select p_partkey, case when p_brand = '' then 'unknown' when p_brand like 'Brand#1%' then 'match' else 'mismatch' end as verdict from part")
def rt_court_verdict(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("p_brand") == "", "unknown").when(F.col("p_brand").startswith("Brand#1"), "match").otherwise("mismatch")
    return table(spark, d, "part").select("p_partkey", verdict.alias("verdict"))


@query(
    "rt_exact_pin",
    "with c as (select o_custkey, min(o_orderkey) as low, max(o_orderkey) as high, min_by(o_orderdate, o_orderkey) as low_day, max_by(o_orderdate, o_orderkey) as high_day from orders group by 1) "
    "select o_custkey, 1 as n, year(low_day) || '/' || low as number, low as o_orderkey from c union all select o_custkey, 2, (year(high_day) + 1) || '/' || high, null from c",
)
def rt_exact_pin(spark: SparkSession, d: str) -> DataFrame:
    """Questions that cite two files by year and number: the one that exists is pinned, the other is not."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"))
    ends = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "year")).alias("low"), F.max(F.struct("o_orderkey", "year")).alias("high"))
    cite = lambda e, late: F.concat(F.lit("E. "), (F.col(f"{e}.year") + late).cast("string"), F.lit("/"), F.col(f"{e}.o_orderkey").cast("string"))
    asked = ends.select("o_custkey", F.concat(F.lit("Bkz. "), cite("low", 0), F.lit(" ile "), cite("high", 1), F.lit(" kararları")).alias("text"))
    parsed = references.references(asked, "o_custkey").where("kind = 'file'").select("o_custkey", "n", "number")
    files = orders.select("o_orderkey", F.concat_ws("/", "year", "o_orderkey").alias("number"))
    return parsed.join(files, "number", "left").select("o_custkey", "n", "number", "o_orderkey")


@query("rt_hydrate_dense", f"with s as ({DENSE_SQL}), t as (select id, row_number() over (order by score desc, id) as rank from s qualify rank <= 50) select id from t where id in (select doc_id from documents)")
def rt_hydrate_dense(spark: SparkSession, d: str) -> DataFrame:
    e, q = first_vector(spark, d)
    visible = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return retrieval.dense(e, q, 50).join(visible, "id", "left_semi").select("id")


STORED_SQL = f"""n as (select doc_id, source, text, trim(regexp_replace({TR_LOWER.format("translate(replace(text, chr(173), ''), '‐‑‒–—−‘’“”', '------' || chr(39) || chr(39) || '\"\"')")}, {BLANKS}, ' ', 'g')) as now from documents),
s as (select *, case when doc_id % 3 = 0 then lower(text) else now end as stored from n)"""


@query("rt_normalizer_drift", f"with {STORED_SQL} select source, count(*) as n, count(*) filter (where stored <> now) as drifted, min(doc_id) filter (where stored <> now) as first_id from s group by 1")
def rt_normalizer_drift(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stored normal form is not that of the normaliser in use, by source.

    A third of them were stored by an older one that only lowered the text; forms are compared
    by their digests.
    """
    now = text.tr_normalize(F.col("text"))
    stored = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(now)
    rows = table(spark, d, "documents").select("source", "doc_id", (F.sha2(stored, 256) != F.sha2(now, 256)).alias("drifted"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("drifted").alias("drifted"), F.min(F.when(F.col("drifted"), F.col("doc_id"))).alias("first_id"))


@query("rt_select_passages", "select doc_id, ordinal from (select conv_id as doc_id, turn as ordinal, row_number() over (partition by conv_id order by length(text) desc, turn) as rn from conversations) where rn <= 2")
def rt_select_passages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.length("text").alias("n"))
    return retrieval.cap_per_document(c, "doc_id", [F.desc("n"), F.asc("ordinal")], 2).drop("n")


# Evidence

SPANS_SQL = "with e as (select d.doc_id, b.item_id, b.text as quote, instr(d.text, b.text) - 1 as start from documents d join benchmark b on contains(d.text, b.text))"


@query("an_locate_quote", f"{SPANS_SQL} select doc_id, item_id, start::bigint as start from e")
def an_locate_quote(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.containing(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"))


@query("ev_validate", "select doc_id, case when n_chars < 60 then 'OUT_OF_RANGE' when doc_id % 7 = 0 then 'QUOTE_HASH' when doc_id % 5 = 0 then 'CONTENT_HASH' else 'OK' end as outcome from documents")
def ev_validate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    quote = F.substring("text", 11, 50)
    spans = t.select(
        "doc_id", F.lit(10).alias("start"), F.lit(60).alias("end"), quote.alias("quote"),
        F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(quote, 256)).alias("quote_sha256"),
        F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("content_sha256"),
    )
    return evidence.validate(spans, t).select("doc_id", "outcome")


#: Evidence rows: passages of ``benchmark`` in documents, with hashes; some are made wrong by rule.
CITED_SQL = f"""{SPANS_SQL}, c as (
  select e.item_id, e.doc_id, case when (e.doc_id + e.item_id) % 7 = 0 then 'QUOTE_HASH' when (e.doc_id + e.item_id) % 5 = 0 then 'CONTENT_HASH' when (e.doc_id + e.item_id) % 11 = 0 then 'QUOTE_DIFFERS' else 'OK' end as made
  from e where e.quote <> ''
), o as (select item_id, doc_id, case when made = 'QUOTE_DIFFERS' then 'QUOTE_DIFFERS' else made end as outcome from c),
v as (select b.item_id as claim, o.outcome, case l.quality when 1 then 'pro' when 0 then 'contra' end as side from benchmark b left join o on o.item_id = b.item_id left join labels l on l.doc_id = o.doc_id)"""


def cited(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every claim (a passage of ``benchmark``), checked: claim, outcome, side.

    Documents of good quality speak for a claim, those of bad quality against it.
    """
    docs, claims = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = evidence.containing(docs, claims).join(claims.select("item_id", F.col("text").alias("quote")), "item_id").join(docs.select("doc_id", F.sha2("text", 256).alias("content")), "doc_id")
    k = F.col("doc_id") + F.col("item_id")
    late = (k % 7 != 0) & (k % 5 != 0) & (k % 11 == 0)
    wrong = F.sha2(F.lit("other"), 256)
    rows = found.select(
        "item_id", "doc_id", F.col("start").alias("start"), (F.col("start") + F.length("quote")).alias("end"), F.when(late, F.reverse("quote")).otherwise(F.col("quote")).alias("quote"),
        F.when(k % 7 == 0, wrong).otherwise(F.sha2("quote", 256)).alias("quote_sha256"), F.when(k % 5 == 0, wrong).otherwise(F.col("content")).alias("content_sha256"),
    )
    checked = evidence.validate(rows, docs).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    side = F.when(F.col("quality") == 1, "pro").when(F.col("quality") == 0, "contra")
    return claims.select("item_id").join(checked.select("item_id", "outcome", side.alias("side")), "item_id", "left").withColumnRenamed("item_id", "claim")


@query("ev_check_citations", f"{CITED_SQL} select claim, count(outcome) as n, count(*) filter (where outcome = 'OK') as n_ok, count(outcome) > 0 and count(outcome) = count(*) filter (where outcome = 'OK') as passes from v group by 1")
def ev_check_citations(spark: SparkSession, d: str) -> DataFrame:
    """Whether all evidence of a claim stands where and as it is cited."""
    return evidence.checked_claims(cited(spark, d)).select("claim", "n", "n_ok", "passes")


@query("ev_verify_bundle", "select count(*) as n, count(*) filter (where n_chars = length(text)) as length_ok, count(distinct sha256(text)) as n_hashes from documents")
def ev_verify_bundle(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") == F.length("text")).alias("length_ok"), F.count_distinct(F.sha2("text", 256)).alias("n_hashes"))


@query("ev_coverage_gate", "select l_orderkey, case when count(*) = 1 then 'bypassed' when avg(l_discount) >= 0.04 then 'passed' else 'failed' end as gate from (select l_orderkey, l_discount::decimal(10,4) as l_discount from lineitem) group by 1")
def ev_coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_discount").cast("decimal(10,4)")
    gate = F.when(F.count("*") == 1, "bypassed").when(F.sum(x) >= F.count("*") * F.lit("0.04").cast("decimal(10,4)"), "passed").otherwise("failed")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(gate.alias("gate"))


@query("ev_finalize", "select o_custkey, bool_and(o_orderstatus <> 'P') and bool_or(o_orderpriority = '1-URGENT') as finalizable from orders group by 1")
def ev_finalize(spark: SparkSession, d: str) -> DataFrame:
    final = F.bool_and(F.col("o_orderstatus") != "P") & F.bool_or(F.col("o_orderpriority") == "1-URGENT")
    return table(spark, d, "orders").groupBy("o_custkey").agg(final.alias("finalizable"))


@query(
    "ev_verdict",
    f"{CITED_SQL}, k as (select claim, count(*) filter (where outcome = 'OK' and side = 'pro') > 0 as pro, count(*) filter (where outcome = 'OK' and side = 'contra') > 0 as contra from v group by 1) "
    "select claim, case when pro and contra then 'DISPUTED' when contra then 'CONTRARY' when pro then 'SUPPORTED' else 'OPEN' end as verdict from k",
)
def ev_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of a claim by the sides of the evidence that holds."""
    return evidence.checked_claims(cited(spark, d)).select("claim", "verdict")


@query("ev_tamper", "select doc_id, sha256(text) <> sha256(case when doc_id % 11 = 0 then text || ' ' else text end) as tampered from documents")
def ev_tamper(spark: SparkSession, d: str) -> DataFrame:
    stored = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (F.sha2("text", 256) != F.sha2(stored, 256)).alias("tampered"))


@query("ev_contrary_coverage", "select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as contrary, case when count(*) filter (where o_orderstatus = 'F') = 0 then 'CONTRARY_NOT_EXECUTED' else 'COVERED' end as reason from orders group by 1")
def ev_contrary_coverage(spark: SparkSession, d: str) -> DataFrame:
    contrary = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), contrary.alias("contrary"), F.when(contrary == 0, "CONTRARY_NOT_EXECUTED").otherwise("COVERED").alias("reason"))


# Analysis


@query("an_aggregate", f"with p as ({PAIRS_SQL}) select verdict, count(*) as n from p group by 1")
def an_aggregate(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("value"))
    return analysis.pairwise(seen, ["l_orderkey", "kind"], "seq", "value").groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "an_compare_values",
    """with v as (select a.o_orderkey as a, a.o_totalprice - 150000 as x, b.o_totalprice - 150000 as y, a.o_orderdate::date as d, b.o_orderdate::date as e, a.o_orderpriority = '1-URGENT' or b.o_orderpriority = '1-URGENT' as vague,
      a.o_orderstatus = 'F' and b.o_orderstatus = 'F' as named from orders a join orders b on b.o_orderkey = a.o_orderkey + 1)
    select a, case when x = y then 'CORROBORATION' when abs(x - y) <= 0.01 * greatest(abs(x), abs(y)) then 'TENSION' else 'CONTRADICTION' end as amounts,
      case when d = e then 'CORROBORATION' when vague then 'TENSION' when not named and date_trunc('month', d) = date_trunc('month', e) then 'TENSION' else 'CONTRADICTION' end as dates from v""",
)
def an_compare_values(spark: SparkSession, d: str) -> DataFrame:
    """Amounts (of either sign) and dates of neighbouring orders; urgent ones count as of vague date."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 150000).alias("x"), F.to_date("o_orderdate").alias("d"), (F.col("o_orderpriority") == "1-URGENT").alias("u"), (F.col("o_orderstatus") == "F").alias("f"))
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("x").alias("y"), F.col("d").alias("e"), F.col("u").alias("v"), F.col("f").alias("g"))
    dates = analysis.compare_dates(F.col("d"), F.col("e"), ~(F.col("u") | F.col("v")), F.col("f") & F.col("g"))
    return o.join(after, "o_orderkey").select(F.col("o_orderkey").alias("a"), analysis.compare_values(F.col("x"), F.col("y")).alias("amounts"), dates.alias("dates"))


@query(
    "an_components",
    """with recursive o as (select lag(o_orderkey) over w as a, o_orderkey as b, date_diff('day', lag(o_orderdate::date) over w, o_orderdate::date) as days from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
    e as (select a, b from o where a is not null and days <= 60),
    l as (select a, b from e union select b, a from e), r(id, c) as (select a, a from l union select l.b, r.c from r join l on l.a = r.id)
    select id, min(c) as component from r group by 1""",
)
def an_components(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer that follow each other within 60 days, joined to groups."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.lag("o_orderkey").over(w).alias("a"), F.col("o_orderkey").alias("b"), F.datediff(F.to_date("o_orderdate"), F.lag(F.to_date("o_orderdate")).over(w)).alias("days"))
    return analysis.groups(o.where("a is not null and days <= 60").select("a", "b"))


@query("an_contra_batches", "select o_custkey, o_orderkey, ceil(row_number() over (partition by o_custkey order by o_orderkey) / 5.0)::int as batch from orders")
def an_contra_batches(spark: SparkSession, d: str) -> DataFrame:
    return analysis.batches(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")], 5)


@query("an_reduce", "with u as (select distinct o_custkey, month(o_orderdate) as m from orders), g as (select o_custkey, m, m - row_number() over (partition by o_custkey order by m) as run from u) select o_custkey, min(m) as first, max(m) as last, count(*) as n from g group by o_custkey, run")
def an_reduce(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "orders").select("o_custkey", F.month("o_orderdate").cast("long").alias("m")).distinct()
    return analysis.gaps(u, "o_custkey", "m")


@query("an_synth_groups", "select coalesce('issue-' || quality::varchar, lang) as grp, count(*) as n from documents left join labels using (doc_id) group by 1")
def an_synth_groups(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    grp = F.coalesce(F.concat(F.lit("issue-"), F.col("quality").cast("string")), F.col("lang"))
    return j.groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))


@query("an_review_grid", "select d.source, r.r_name, count(*) filter (where d.n_chars > 500 * r.r_regionkey) as answered, count(*) as n from documents d, region r group by 1, 2")
def an_review_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "documents").select("source", "n_chars").crossJoin(F.broadcast(table(spark, d, "region")))
    return grid.groupBy("source", "r_name").agg(F.count_if(F.col("n_chars") > 500 * F.col("r_regionkey")).alias("answered"), F.count("*").alias("n"))


@query("an_clause_check", "select doc_id, c.clause, regexp_matches(lower(text), c.pattern) as present from documents, (values ('license', 'licen[sc]e'), ('contact', '@')) c(clause, pattern)")
def an_clause_check(spark: SparkSession, d: str) -> DataFrame:
    clauses = {"license": "licen[sc]e", "contact": "@"}
    rows = F.array(*[F.struct(F.lit(c).alias("clause"), F.lower("text").rlike(p).alias("present")) for c, p in clauses.items()])
    return table(spark, d, "documents").select("doc_id", F.explode(rows).alias("c")).select("doc_id", "c.*")


# Metrics

RANKS_SQL = """ranked as (select o_custkey as query, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
gold as (select o_custkey as query, o_orderkey as id from orders where o_orderpriority in ('1-URGENT', '2-HIGH')),
n as (select query, count(*) as n from gold group by 1), hit as (select r.* from ranked r join gold using (query, id)),
m as (select n.query, coalesce(count(hit.id) filter (where rank <= 5), 0) / n.n::double as recall, coalesce(1.0::double / min(rank), 0) as rr,
  coalesce(sum(1.0::double / log2(rank + 1)) filter (where rank <= 5), 0) / list_sum(list_transform(range(1, least(n.n, 5) + 1), lambda r: 1.0::double / log2(r + 1))) as ndcg
  from n left join hit on hit.query = n.query group by n.query, n.n)"""


def order_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ranked = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), rank.alias("rank"))
    gold = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"))
    return analysis.ranking_metrics(ranked, gold, 5)


@query("me_recall", f"with {RANKS_SQL} select query, round(recall, 6) as recall from m")
def me_recall(spark: SparkSession, d: str) -> DataFrame:
    return order_metrics(spark, d).select("query", F.round("recall", 6).alias("recall"))


@query("me_rr", f"with {RANKS_SQL} select query, round(rr, 6) as rr from m")
def me_rr(spark: SparkSession, d: str) -> DataFrame:
    return order_metrics(spark, d).select("query", F.round("rr", 6).alias("rr"))


@query("me_ndcg", f"with {RANKS_SQL} select query, round(ndcg, 6) as ndcg from m")
def me_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return order_metrics(spark, d).select("query", F.round("ndcg", 6).alias("ndcg"))


@query("me_full_report", f"with {RANKS_SQL} select round(avg(recall), 6) as recall, round(avg(rr), 6) as mrr, round(avg(ndcg), 6) as ndcg, count(*) as n from m")
def me_full_report(spark: SparkSession, d: str) -> DataFrame:
    m = order_metrics(spark, d)
    return m.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("n"))


@query("me_gates", f"with {RANKS_SQL}, a as (select avg(recall) as recall, avg(ndcg) as ndcg from m) select 'recall' as gate, recall >= 0.2 as passed from a union all select 'ndcg', ndcg >= 0.99 from a")
def me_gates(spark: SparkSession, d: str) -> DataFrame:
    a = order_metrics(spark, d).agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), (F.col(g) >= least).alias("passed")) for g, least in (("recall", 0.2), ("ndcg", 0.99))])
    return a.select(F.explode(gates).alias("g")).select("g.*")


@query("me_abstention", "select round(count(*) filter (where toxic = 1 and quality = 0) / nullif(count(*) filter (where toxic = 1), 0)::double, 6) as precision, round(count(*) filter (where toxic = 1 and quality = 0) / nullif(count(*) filter (where quality = 0), 0)::double, 6) as recall from labels")
def me_abstention(spark: SparkSession, d: str) -> DataFrame:
    both = F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0))
    share = lambda c: F.round(both / F.nullif(F.count_if(c), F.lit(0)), 6)
    return table(spark, d, "labels").agg(share(F.col("toxic") == 1).alias("precision"), share(F.col("quality") == 0).alias("recall"))


@query("me_integrity", "select count(*) as n, count(*) filter (where d.doc_id is null) as fabricated from labels l left join documents d using (doc_id)")
def me_integrity(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").select("doc_id", F.lit(True).alias("known"))
    return table(spark, d, "labels").join(known, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("fabricated"))


@query("me_rank_passages", "select vec_id, row_number() over (partition by label order by round(embedding[1]::double, 6) desc, vec_id)::int as rank from embeddings")
def me_rank_passages(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return table(spark, d, "embeddings").select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy(score.desc(), "vec_id")).alias("rank"))


# Queues: events read as jobs

JOBS_SQL = """jobs as (select event_id as job_id, event_type as queue, ts as available_at, (user_id % 6)::int as attempts,
  case event_id % 4 when 0 then 'running' when 1 then 'done' else 'queued' end as state, ts + interval 1 hour as leased_until, user_id as job_key from events)"""
NOW = "2024-01-15 12:00:00"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("queue"), at.alias("available_at"), (F.col("user_id") % 6).cast("int").alias("attempts"),
        F.when(k == 0, "running").when(k == 1, "done").otherwise("queued").alias("state"), (at + F.expr("interval 1 hour")).alias("leased_until"), F.col("user_id").alias("job_key"),
    )


@query("sm_claim_jobs", f"with {JOBS_SQL} select job_id, queue from (select *, row_number() over (partition by queue order by available_at, job_id) as rn from jobs where state = 'queued' and available_at <= timestamp '{NOW}') where rn <= 20")
def sm_claim_jobs(spark: SparkSession, d: str) -> DataFrame:
    return queues.claim(jobs(spark, d), F.lit(NOW).cast("timestamp"), 20).where("claimed").select("job_id", "queue")


@query("sm_fail_job", f"with {JOBS_SQL} select job_id, case when state = 'running' and attempts >= 3 then 'dead' when state = 'running' then 'queued' else state end as state from jobs")
def sm_fail_job(spark: SparkSession, d: str) -> DataFrame:
    return queues.fail(jobs(spark, d), F.col("state") == "running", F.lit(NOW).cast("timestamp"), 3, 30).select("job_id", "state")


@query("sm_reap", f"with {JOBS_SQL} select job_id, case when state = 'running' and leased_until < timestamp '{NOW}' and attempts >= 5 then 'dead' when state = 'running' and leased_until < timestamp '{NOW}' then 'queued' else state end as state from jobs")
def sm_reap(spark: SparkSession, d: str) -> DataFrame:
    return queues.reap(jobs(spark, d), F.lit(NOW).cast("timestamp"), 5).select("job_id", "state")


@query("sm_enqueue_idempotent", f"with {JOBS_SQL}, new as (select distinct 'click' as queue, o_custkey as job_key from orders) select n.queue, n.job_key from new n where not exists (select 1 from jobs j where j.queue = n.queue and j.job_key = n.job_key and j.state in ('queued', 'running'))")
def sm_enqueue_idempotent(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").select(F.lit("click").alias("queue"), F.col("o_custkey").alias("job_key"))
    return queues.enqueue(jobs(spark, d), new).select("queue", "job_key")


@query("sm_claim_embed", f"with {JOBS_SQL} select job_id from (select *, row_number() over (partition by queue order by available_at, job_id) as rn from jobs j where state = 'queued' and available_at <= timestamp '{NOW}' and exists (select 1 from orders where o_custkey = j.job_key)) where rn <= 10")
def sm_claim_embed(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").select(F.col("o_custkey").alias("job_key"))
    return queues.claim(jobs(spark, d).join(live, "job_key", "left_semi"), F.lit(NOW).cast("timestamp"), 10).where("claimed").select("job_id")


@query("sm_step_replay", "select user_id, event_type, min(event_id) as first_step, count(*) - 1 as replays from events group by 1, 2")
def sm_step_replay(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_step"), (F.count("*") - 1).alias("replays"))


@query("sm_usage_ceiling", "select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as calls, count(*) > 5 as over from events group by 1, 2")
def sm_usage_ceiling(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "calls", (F.col("calls") > 5).alias("over"))


@query("sm_budget", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 4) as spent from events")
def sm_budget(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("spent"))
