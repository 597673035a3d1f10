"""Queries for sinks, catalogues, queue claims and further retrieval and evidence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, vectors
from corpusloom.operators import evidence, analysis, parsing, queues, retrieval
from corpusloom.plans.corpus import CHUNKS_SQL, DENSE_SQL, JOBS_SQL, NOW, WORDS_SQL, first_vector, jobs
from corpusloom.plans.registry import query
from corpusloom.plans.relational import LANES_SQL, lanes
from corpusloom.sources import spool
from corpusloom.tables import table

# Sinks and catalogues


@query("snk_segment_insert", "select distinct l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def snk_segment_insert(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return spool.insert_new(items, items.join(stored, "l_orderkey", "left_semi"), ["l_orderkey", "l_linenumber"])


@query("snk_segment_resync", "with a as (select l_orderkey as k, count(*) as v from lineitem where l_shipdate < timestamp '1995-06-01' group by 1), b as (select l_orderkey as k, count(*) as v from lineitem where l_shipdate >= timestamp '1995-06-01' group by 1) select coalesce(a.k, b.k) as k, case when b.k is null then 'added' when a.k is null then 'removed' when a.v = b.v then 'same' else 'changed' end as state from a full outer join b on a.k = b.k")
def snk_segment_resync(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    split = F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    per = lambda rows: rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("v"))
    return spool.resync(per(t.where(split)), per(t.where(~split)), ["k"], "v").select("k", "state")


@query("snk_csv_export", """select '"' || c_custkey || '","' || replace(c_name, '"', '""') || '"' as value from customer""")
def snk_csv_export(spark: SparkSession, d: str) -> DataFrame:
    fields = [text.csv_field(F.col(c).cast("string")) for c in ("c_custkey", "c_name")]
    return table(spark, d, "customer").select(F.concat_ws(",", *fields).alias("value"))


@query("snk_ics_export", "select 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || o_orderpriority || chr(13) || chr(10) || 'END:VEVENT' as value from orders")
def snk_ics_export(spark: SparkSession, d: str) -> DataFrame:
    return spool.calendar_feed(table(spark, d, "orders"), "o_orderkey", "o_orderdate", "o_orderpriority")


@query("snk_markdown_export", "select '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as value from nation")
def snk_markdown_export(spark: SparkSession, d: str) -> DataFrame:
    return spool.markdown_table(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("snk_archive_manifest", "select page_id as path, length(html) as n_chars, sha256(html) as sha256 from pages")
def snk_archive_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("path"), F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("sha256"))


@query("cat_sources", "with c(source, kind, enabled) as (values ('src0', 'court', true), ('src1', 'law', true), ('src2', 'law', false)) select d.doc_id, c.kind from documents d join c using (source) where enabled")
def cat_sources(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([("src0", "court", True), ("src1", "law", True), ("src2", "law", False)], "source string, kind string, enabled boolean")
    return table(spark, d, "documents").join(F.broadcast(c.where("enabled")), "source").select("doc_id", "kind")


@query("cat_manifest", "with c(lang) as (values ('en'), ('de'), ('it')) select c.lang, count(d.doc_id) as n, case when count(d.doc_id) = 0 then 'gap' else 'covered' end as state from c left join documents d using (lang) group by 1")
def cat_manifest(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([("en",), ("de",), ("it",)], "lang string")
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    j = c.join(n, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))
    return j.withColumn("state", F.when(F.col("n") == 0, "gap").otherwise("covered"))


@query("ig_migration_ledger", "select n_nationkey as id, case when n_nationkey >= 20 then 'unknown' when n_nationkey % 3 = 0 then 'applied' else 'pending' end as state from nation")
def ig_migration_ledger(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    expected, applied = ids.where("id < 20"), ids.where("id >= 20 or id % 3 = 0")
    j = expected.withColumn("expected", F.lit(True)).join(applied.withColumn("applied", F.lit(True)), "id", "full")
    return j.select("id", F.when(F.col("expected").isNull(), "unknown").when(F.col("applied"), "applied").otherwise("pending").alias("state"))


# Lexical statistics and fusion


@query("ag_doc_frequency", r"with w as (select doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3))) as word from documents) select word, count(*) as df from w group by 1 having count(*) >= 5")
def ag_doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("df")).where("df >= 5")


@query("mt_bm25_idf", "select o_custkey, round(ln(1 + (greatest(1000, count(*)) - count(*) + 0.5::double) / (count(*) + 0.5::double)), 6) as idf from orders group by 1")
def mt_bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("df"))
    return df.select("o_custkey", F.round(vectors.bm25_idf(F.lit(1000), F.col("df")), 6).alias("idf"))


@query("mt_rrf", "select l_orderkey, l_linenumber, round(0.7::double / (60 + l_linenumber), 9) as share from lineitem")
def mt_rrf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(vectors.rrf(F.col("l_linenumber"), 0.7), 9).alias("share"))


@query("wn_semantic_rank", f"with s as ({DENSE_SQL}) select id, row_number() over (order by 1 - score, id)::int as rank from s order by rank limit 40")
def wn_semantic_rank(spark: SparkSession, d: str) -> DataFrame:
    e, q = first_vector(spark, d)
    return retrieval.dense(e, q, 40).select("id", "rank")


@query("rt_dense_ann", f"with s as ({DENSE_SQL}) select id from s order by score desc, id limit 10")
def rt_dense_ann(spark: SparkSession, d: str) -> DataFrame:
    e, q = first_vector(spark, d)
    return retrieval.dense(e, q, 10).select("id")


@query("rt_hybrid_alpha", "with k as (select l_partkey as id, sum(l_quantity) as kw from lineitem group by 1) select p_partkey as id, round(0.6 * p_retailprice / 1000 + 0.4 * coalesce(kw, 0) / 1000, 6)::double as score from part left join k on k.id = p_partkey")
def rt_hybrid_alpha(spark: SparkSession, d: str) -> DataFrame:
    kw = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("kw"))
    j = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice").join(kw, "id", "left")
    return j.select("id", F.round(0.6 * F.col("p_retailprice") / 1000 + 0.4 * F.coalesce("kw", F.lit(0.0)) / 1000, 6).alias("score"))


@query("rt_relation_lane", f"with {LANES_SQL} select distinct l_suppkey as id from lineitem where l_partkey in (select id from lex where rank <= 10) and l_suppkey not in (select id from lex)")
def rt_relation_lane(spark: SparkSession, d: str) -> DataFrame:
    a, _ = lanes(spark, d)
    seeds = a.where("rank <= 10").select(F.col("id").alias("l_partkey"))
    reached = table(spark, d, "lineitem").join(seeds, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("id")).distinct()
    return reached.join(a, "id", "left_anti").select("id")


@query("rt_citation_expand", f"with {LANES_SQL}, seeds as (select * from lex where rank <= 5), sub as (select s.rank as seed_rank, l_suppkey as id, row_number() over (partition by s.rank order by min(l_orderkey), l_suppkey) as sub_rank from seeds s join lineitem on l_partkey = s.id group by s.rank, l_suppkey) select seed_rank, id, sub_rank from sub where sub_rank <= 3")
def rt_citation_expand(spark: SparkSession, d: str) -> DataFrame:
    a, _ = lanes(spark, d)
    seeds = a.where("rank <= 5").select(F.col("rank").alias("seed_rank"), F.col("id").alias("l_partkey"))
    sub = table(spark, d, "lineitem").join(seeds, "l_partkey").groupBy("seed_rank", F.col("l_suppkey").alias("id")).agg(F.min("l_orderkey").alias("first"))
    rn = F.row_number().over(Window.partitionBy("seed_rank").orderBy("first", "id"))
    return sub.withColumn("sub_rank", rn).where("sub_rank <= 3").select("seed_rank", "id", "sub_rank")


@query("rt_lexical_strict", f"with {CHUNKS_SQL}, w as (select doc_id, ordinal, {WORDS_SQL} as w from chunks) select doc_id, ordinal::int as ordinal from w where list_has_all(w, ['the', 'license'])")
def rt_lexical_strict(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("the"), F.lit("license"))
    c = retrieval.chunks(table(spark, d, "documents"))
    return c.where(F.size(F.array_except(wanted, text.words(F.col("body")))) == 0).select("doc_id", "ordinal")


@query("rt_expand_query", f"with {CHUNKS_SQL}, w as (select doc_id, {WORDS_SQL} as w from chunks), x(word, weight) as (values ('license', 1.0::double), ('lizenz', 0.5::double), ('copyright', 0.5::double), ('apache', 0.5::double)) select doc_id, round(max(s), 6) as score from (select doc_id, sum(weight) as s from (select doc_id, row_number() over () as chunk, w from w) t join x on list_contains(t.w, x.word) group by doc_id, chunk) group by 1")
def rt_expand_query(spark: SparkSession, d: str) -> DataFrame:
    """A query word with its related terms at half weight."""
    x = spark.createDataFrame([("license", 1.0), ("lizenz", 0.5), ("copyright", 0.5), ("apache", 0.5)], "word string, weight double")
    hits = retrieval.postings(retrieval.chunks(table(spark, d, "documents"))).join(F.broadcast(x), "word")
    per = hits.groupBy("doc_id", "ordinal").agg(F.sum("weight").alias("s"))
    return per.groupBy("doc_id").agg(F.round(F.max("s"), 6).alias("score"))


@query("rt_rerank", "select doc_id, max(n)::bigint as best from (select doc_id, len(regexp_extract_all(lower(substring(text, (i * 750 + 1)::int, 1000)), 'the')) as n from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 250) / 750.0)::int))) as i from documents)) group by 1")
def rt_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Best window of each document by occurrences of a term."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 250) / 750.0)).cast("int")
    w = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    part = F.lower(F.substring(F.col("text"), F.col("i") * 750 + 1, F.lit(1000)))
    return w.groupBy("doc_id").agg(F.max(F.regexp_count(part, F.lit("the"))).cast("long").alias("best"))


@query("rt_divergence", f"with {LANES_SQL} select sem.id from sem left join lex on lex.id = sem.id where lex.id is null order by sem.rank limit 6")
def rt_divergence(spark: SparkSession, d: str) -> DataFrame:
    a, b = lanes(spark, d)
    return b.join(a, "id", "left_anti").orderBy("rank").limit(6).select("id")


@query("rt_federated_search", "select source, case when source = 'src3' then 'FAILED' else 'OK' end as status, case when source = 'src3' then 0 else count(*) filter (where contains(lower(text), 'license')) end as hits from documents group by 1")
def rt_federated_search(spark: SparkSession, d: str) -> DataFrame:
    """One row a source: a source that fails is a row, not an error of the whole."""
    failed = F.col("source") == "src3"
    hits = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.lower("text").contains("license")).alias("n"))
    return hits.select("source", F.when(failed, "FAILED").otherwise("OK").alias("status"), F.when(failed, F.lit(0)).otherwise(F.col("n")).alias("hits"))


@query("rt_related", "select sha256(text) as identity, min(doc_id) as doc_id, count(distinct source) as n_sources, count(*) as n from documents where contains(lower(text), 'license') group by 1")
def rt_related(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.lower("text").contains("license"))
    return t.groupBy(F.sha2("text", 256).alias("identity")).agg(F.min("doc_id").alias("doc_id"), F.count_distinct("source").alias("n_sources"), F.count("*").alias("n"))


@query("rt_trigram", r"with t as (select p_partkey, list_distinct(list_transform(range(1, length('  ' || lower(p_name) || ' ') - 1), lambda i: substring('  ' || lower(p_name) || ' ', i, 3))) as g from part), q as (select list_distinct(list_transform(range(1, length('  ' || lower(p_name) || ' ') - 1), lambda i: substring('  ' || lower(p_name) || ' ', i, 3))) as g from part where p_partkey = 1) select p_partkey, round(len(list_intersect(t.g, q.g)) / len(q.g)::double, 6) as similarity from t, q where len(list_intersect(t.g, q.g)) / len(q.g)::double >= 0.5")
def rt_trigram(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold at least half of a query's trigrams, by postings of trigrams."""
    part = table(spark, d, "part")
    wanted = parsing.trigrams_of(part.where("p_partkey = 1").select("p_name").first()[0])
    return parsing.trigram_search(part.select("p_partkey", "p_name"), "p_partkey", "p_name", wanted, 0.5).select("p_partkey", F.round("similarity", 6).alias("similarity"))


# Joins and analysis


@query("jn_claim_evidence", r"with c(claim, words) as (values (1, ['the', 'license', 'work']), (2, ['with', 'all', 'the', 'and'])), w as (select item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3)) as w from benchmark), s as (select claim, item_id, len(list_intersect(words, w)) / len(words)::double as score from c, w) select claim, item_id from (select *, row_number() over (partition by claim order by score desc, item_id) as rn from s where score > 0) where rn <= 5")
def jn_claim_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The five pieces of evidence that share most words with each claim of a small set."""
    claims = spark.createDataFrame([(1, ["the", "license", "work"]), (2, ["with", "all", "the", "and"])], "claim int, words array<string>")
    e = table(spark, d, "benchmark").select("item_id", F.explode(text.words(F.col("text"))).alias("word"))
    c = claims.select("claim", F.size("words").alias("n"), F.explode("words").alias("word"))
    s = e.join(F.broadcast(c), "word").groupBy("claim", "item_id").agg((F.count("*") / F.first("n")).alias("score"))
    rn = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("score"), "item_id"))
    return s.withColumn("rn", rn).where("rn <= 5").select("claim", "item_id")


@query("jn_semantic_pairs", f"with w as (select item_id, {WORDS_SQL.replace('body', 'text')} as w from benchmark) select a.item_id as a, b.item_id as b from w a join w b on a.item_id < b.item_id where len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::double >= 0.2")
def jn_semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages of word-set similarity 0.2 or more, met on words they share."""
    return parsing.similar_pairs(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.words(F.col("text")).alias("w")), 0.2)


@query("jn_reference_resolve", "with r as (select s_suppkey, 'Customer#' || lpad((s_suppkey * 3)::varchar, 9, '0') as name from supplier) select s_suppkey, coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when a.c_custkey is not null then 'number' when b.c_custkey is not null then 'name' else 'none' end as how from r left join customer a on a.c_custkey = r.s_suppkey * 3 and r.s_suppkey % 2 = 0 left join customer b on b.c_name = r.name")
def jn_reference_resolve(spark: SparkSession, d: str) -> DataFrame:
    """References resolved by number where they have one, else by name."""
    r = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 3).alias("number"), F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")).alias("name"))
    c = table(spark, d, "customer")
    j = r.join(c.select(F.col("c_custkey").alias("a")), F.col("number") == F.col("a"), "left").join(c.select(F.col("c_custkey").alias("b"), "c_name"), F.col("name") == F.col("c_name"), "left")
    how = F.when(F.col("a").isNotNull(), "number").when(F.col("b").isNotNull(), "name").otherwise("none")
    return j.select("s_suppkey", F.coalesce("a", "b").alias("c_custkey"), how.alias("how"))


@query("jn_corpus_citation", "select l.doc_id, case when d.doc_id is null then 'ABSENT' when l.quality = 0 then 'WEAK' else 'FOUND' end as status from labels l left join documents d using (doc_id)")
def jn_corpus_citation(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").select("doc_id", F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "ABSENT").when(F.col("quality") == 0, "WEAK").otherwise("FOUND")
    return table(spark, d, "labels").join(known, "doc_id", "left").select("doc_id", status.alias("status"))


@query("st_near_dup_collapse", f"with w as (select item_id, {WORDS_SQL.replace('body', 'text')} as w from benchmark) select item_id from w b where not exists (select 1 from w a where a.item_id < b.item_id and len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::double >= 0.8)")
def st_near_dup_collapse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.words(F.col("text")).alias("w"))
    later = parsing.similar_pairs(rows, 0.8).select(F.col("b").alias("id"))
    return rows.join(later, "id", "left_anti").select(F.col("id").alias("item_id"))


@query("an_candidates", "select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey where (a.o_orderpriority = b.o_orderpriority)::int + (a.o_orderstatus = b.o_orderstatus)::int + (abs(a.o_totalprice - b.o_totalprice) < 10000)::int >= 2")
def an_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one case that agree in two of three signals."""
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").alias("x"))
    j = o.withColumnRenamed("x", "a").join(o.withColumnRenamed("x", "b"), "o_custkey").where("a.o_orderkey < b.o_orderkey")
    signals = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("o_orderpriority", "o_orderstatus")] + [F.abs(F.col("a.o_totalprice") - F.col("b.o_totalprice")) < 10000]
    score = sum((s.cast("int") for s in signals), F.lit(0))
    return j.where(score >= 2).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query("an_synth_levels", "with l1 as (select o_custkey, ceil(row_number() over (partition by o_custkey order by o_orderkey) / 4.0)::int as g from orders), l2 as (select o_custkey, count(distinct g) as n from l1 group by 1) select o_custkey, n as level1, ceil(n / 4.0)::bigint as level2 from l2")
def an_synth_levels(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a first level and groups of a second, of four each."""
    first = analysis.batches(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")], 4)
    return first.groupBy("o_custkey").agg(F.count_distinct("batch").alias("level1")).withColumn("level2", F.ceil(F.col("level1") / 4.0))


@query("an_map", "select l_returnflag, l_linestatus, count(*) as units, count(distinct l_partkey) as reused from lineitem group by 1, 2")
def an_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("units"), F.count_distinct("l_partkey").alias("reused"))


@query("an_intel", "select user_id, min(ts) as first_at, max(ts) as last_at, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1")
def an_intel(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), kinds.alias("kinds"))


@query("an_citation_audit", "with c as (select l_partkey as k, count(*) as n from lineitem group by 1) select k, n, case when p.p_partkey is null then 'absent' when n > 40 then 'ambiguous' else 'found' end as state from c left join part p on p.p_partkey = c.k")
def an_citation_audit(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    j = c.join(table(spark, d, "part").select("p_partkey"), F.col("k") == F.col("p_partkey"), "left")
    return j.select("k", "n", F.when(F.col("p_partkey").isNull(), "absent").when(F.col("n") > 40, "ambiguous").otherwise("found").alias("state"))


@query("ev_coverage", r"with q(word) as (values ('the'), ('license'), ('with')), w as (select item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3))) as word from benchmark), n as (select count(*) as n from benchmark), f as (select q.word, case when count(w.item_id) * 2 > any_value(n.n) then 0.5::double else 1.0::double end as weight from q left join w using (word), n group by 1) select w.item_id, round(sum(weight) / (select sum(weight) from f), 6) as coverage from w join f using (word) group by 1")
def ev_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of question words by weight; words of over half the passages weigh half."""
    q = spark.createDataFrame([("the",), ("license",), ("with",)], "word string")
    passages = table(spark, d, "benchmark")
    w = passages.select("item_id", F.explode(text.words(F.col("text"))).alias("word")).join(F.broadcast(q), "word")
    n = passages.agg(F.count("*").alias("n"))
    f = q.join(w.groupBy("word").agg(F.count("*").alias("df")), "word", "left").crossJoin(F.broadcast(n))
    f = f.select("word", F.when(F.coalesce("df", F.lit(0)) * 2 > F.col("n"), 0.5).otherwise(1.0).alias("weight"))
    total = f.agg(F.sum("weight").alias("total"))
    per = w.join(F.broadcast(f), "word").groupBy("item_id").agg(F.sum("weight").alias("weight")).crossJoin(F.broadcast(total))
    return per.select("item_id", F.round(F.col("weight") / F.col("total"), 6).alias("coverage"))


@query("ev_entailment", f"with w as (select item_id, {WORDS_SQL.replace('body', 'text')} as w, list_distinct(regexp_extract_all(text, '[0-9]+')) as n from benchmark), s as (select a.item_id, len(list_intersect(a.w, b.w)) / len(a.w)::double as overlap, len(a.n) = len(list_intersect(a.n, b.n)) as same from w a join w b on b.item_id = a.item_id + 1) select item_id, round(case when same then overlap else least(overlap, 0.2) end, 6)::double as entailment from s")
def ev_entailment(spark: SparkSession, d: str) -> DataFrame:
    """Share of a claim's words in a passage, held down where numbers are missing."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)))
    w = table(spark, d, "benchmark").select("item_id", text.words(F.col("text")).alias("w"), numbers.alias("n"))
    after = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"), F.col("n").alias("m"))
    overlap = F.size(F.array_intersect("w", "v")) / F.size("w")
    same = F.size(F.array_except("n", "m")) == 0
    return w.join(after, "item_id").select("item_id", F.round(F.when(same, overlap).otherwise(F.least(overlap, F.lit(0.2))), 6).alias("entailment"))


QUOTED_SQL = r"""q as (
  select item_id, case item_id % 3 when 0 then text when 1 then upper(text) else regexp_replace(text, '^(\S+\s+\S+\s+\S+\s+)\S+', '\1altered') end as quote from benchmark
), w as (select item_id, quote, list_filter(string_split_regex(lower(quote), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from q),
r as (select *, list_filter(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' ')), lambda x: x <> '') as runs from w),
t as (select doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from documents),
u as (select doc_id, text, words, list_filter(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' ')), lambda x: x <> '') as runs from t),
m as (select item_id, doc_id, count(*) as n from (select item_id, unnest(list_distinct(runs)) as run from r) a join (select doc_id, unnest(list_distinct(runs)) as run from u) b using (run) group by 1, 2),
b as (select * from m qualify row_number() over (partition by item_id order by n desc, doc_id) = 1),
x as (select r.item_id, b.doc_id, coalesce(b.n, 0)::double / len(list_distinct(r.runs)) as share, r.quote, r.words, r.runs, u.text, u.words as own, u.runs as own_runs from r left join b using (item_id) left join u on u.doc_id = b.doc_id),
s as (select *, case when contains(text, quote) then 'VERBATIM' when contains(' ' || array_to_string(own, ' ') || ' ', ' ' || array_to_string(words, ' ') || ' ') then 'FOLDED' when share >= 0.5 then 'ALTERED' else 'MISSING' end as state from x)"""


@query(
    "ev_altered_quotes",
    f"with {QUOTED_SQL} select item_id, case when state <> 'MISSING' then doc_id end as doc_id, state, round(share, 6) as share, case when state = 'ALTERED' then list_position(list_transform(runs, lambda x: list_contains(own_runs, x)), false) - 1 end::bigint as altered_at from s",
)
def ev_altered_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of ``benchmark`` in the documents: as they are, in capitals, or with their fourth word changed."""
    changed = F.regexp_replace("text", r"^(\S+\s+\S+\s+\S+\s+)\S+", "$1altered")
    k = F.col("item_id") % 3
    quotes = table(spark, d, "benchmark").select("item_id", F.when(k == 0, F.col("text")).when(k == 1, F.upper("text")).otherwise(changed).alias("text"))
    return evidence.quote_states(table(spark, d, "documents"), quotes)


@query("ev_pack", "select doc_id, case when n_chars < 100 then 'TOO_SHORT' when rn > 1 then 'DUPLICATE' else 'ACCEPTED' end as outcome from (select doc_id, n_chars, row_number() over (partition by sha256(text) order by doc_id) as rn from documents)")
def ev_pack(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    t = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h")).withColumn("rn", rn)
    return t.select("doc_id", F.when(F.col("n_chars") < 100, "TOO_SHORT").when(F.col("rn") > 1, "DUPLICATE").otherwise("ACCEPTED").alias("outcome"))


# Metrics


@query("me_ndcg_graded", "with r as (select l_orderkey as q, l_linenumber, l_quantity::int % 4 as rel, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rank, row_number() over (partition by l_orderkey order by l_quantity::int % 4 desc, l_linenumber) as ideal from lineitem) select q, round(sum((pow(2, rel) - 1) / log2(rank + 1)) / nullif(sum((pow(2, rel) - 1) / log2(ideal + 1)), 0), 6) as ndcg from r group by 1")
def me_ndcg_graded(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("l_quantity").cast("int") % 4
    order = lambda *c: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*c))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), rel.alias("rel"), order(F.desc("l_extendedprice"), "l_linenumber").alias("rank"), order(rel.desc(), "l_linenumber").alias("ideal"))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    best = F.sum(gain / F.log2(F.col("ideal") + 1))
    return r.groupBy("q").agg(F.round(F.when(best > 0, F.sum(gain / F.log2(F.col("rank") + 1)) / best), 6).alias("ndcg"))


@query("me_form_parity", "select o_custkey, bool_or(o_orderstatus = 'F') as full_form, bool_or(o_orderpriority = '1-URGENT') as short_form, bool_or(o_orderstatus = 'F') = bool_or(o_orderpriority = '1-URGENT') as same from orders group by 1")
def me_form_parity(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.bool_or(F.col("o_orderstatus") == "F"), F.bool_or(F.col("o_orderpriority") == "1-URGENT")
    return table(spark, d, "orders").groupBy("o_custkey").agg(a.alias("full_form"), b.alias("short_form"), (a == b).alias("same"))


@query("me_coverage_gate", "select case when n = 1 then 'bypassed' when n >= 4 then 'passed' else 'failed' end as gate, count(*) as queries from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1")
def me_coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    gate = F.when(F.col("n") == 1, "bypassed").when(F.col("n") >= 4, "passed").otherwise("failed")
    return n.groupBy(gate.alias("gate")).agg(F.count("*").alias("queries"))


# Text functions


@query("fn_quote_fold", r"select doc_id, regexp_replace(replace(replace(lower(text), '&amp;', '&'), '&quot;', '\"'), '[^\p{L}\p{N}]+', ' ', 'g') as folded from documents")
def fn_quote_fold(spark: SparkSession, d: str) -> DataFrame:
    plain = F.replace(F.replace(F.lower("text"), F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ").alias("folded"))


@query("ps_evidence_refs", r"select doc_id, len(list_distinct(list_concat(regexp_extract_all(text, '[0-9]+/[0-9]+'), regexp_extract_all(text, '[A-Z]{2,}-[0-9]+')))) as n_refs from documents")
def ps_evidence_refs(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_union(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in ("([0-9]+/[0-9]+)", "([A-Z]{2,}-[0-9]+)")])
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_refs"))


@query("mt_resolver_conf", "select o_orderkey, round((0.5 * (o_orderstatus = 'F')::int + 0.3 * (o_totalprice > 100000)::int + case when o_custkey % 2 = 0 then 0.1 else 0 end) / (0.8 + case when o_custkey % 2 = 0 then 0.1 else 0 end), 6)::double as confidence from orders")
def mt_resolver_conf(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean over the signals in use."""
    used = F.col("o_custkey") % 2 == 0
    total = 0.5 * (F.col("o_orderstatus") == "F").cast("int") + 0.3 * (F.col("o_totalprice") > 100000).cast("int") + F.when(used, 0.1).otherwise(0.0)
    return table(spark, d, "orders").select("o_orderkey", F.round(total / (0.8 + F.when(used, 0.1).otherwise(0.0)), 6).alias("confidence"))


# Queue claims

CLAIM_SQL = "with {jobs} select job_id from (select *, row_number() over (partition by queue order by available_at, job_id) as rn from jobs j where state = 'queued' and available_at <= timestamp '{now}' and {rule}) where rn <= {n}"


@query("sm_claim_cells", CLAIM_SQL.format(jobs=JOBS_SQL, now=NOW, rule="attempts < 3", n=8))
def sm_claim_cells(spark: SparkSession, d: str) -> DataFrame:
    return queues.claim(jobs(spark, d).where("attempts < 3"), F.lit(NOW).cast("timestamp"), 8).where("claimed").select("job_id")


@query("sm_claim_units", CLAIM_SQL.format(jobs=JOBS_SQL, now=NOW, rule="job_key % 2 = 0", n=12))
def sm_claim_units(spark: SparkSession, d: str) -> DataFrame:
    return queues.claim(jobs(spark, d).where("job_key % 2 = 0"), F.lit(NOW).cast("timestamp"), 12).where("claimed").select("job_id")


@query("sm_claim_tasks", CLAIM_SQL.format(jobs=JOBS_SQL, now=NOW, rule="queue <> 'error'", n=5))
def sm_claim_tasks(spark: SparkSession, d: str) -> DataFrame:
    return queues.claim(jobs(spark, d).where("queue <> 'error'"), F.lit(NOW).cast("timestamp"), 5).where("claimed").select("job_id")
