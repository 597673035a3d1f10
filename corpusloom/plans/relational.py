"""Queries for filters, joins, aggregations, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import temporal, text
from corpusloom.operators import versions
from corpusloom.plans.registry import query
from corpusloom.tables import table

FOLDED = "translate(lower(translate({}, 'İI', 'iı')), 'ıçğöşüâîûİI', 'icgosuaiuii')"


# Projections and filters


@query("prj_provenance", "select l_orderkey, l_linenumber, o_custkey, o_orderdate, c_name, c_mktsegment, l_quantity from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey")
def prj_provenance(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("l_orderkey", "l_linenumber", "o_custkey", "o_orderdate", "c_name", "c_mktsegment", "l_quantity")


@query("flt_visibility", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderdate < timestamp '1997-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def flt_visibility(spark: SparkSession, d: str) -> DataFrame:
    rules = [F.col("o_orderstatus") == "F", F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")]
    out = table(spark, d, "orders")
    for rule in rules:
        out = out.where(rule)
    return out.select("o_orderkey")


VERSIONS_SQL = """versions as (select o_custkey as document_id, o_orderkey as version_id, o_orderdate::date as valid_from,
  min(o_orderdate::date) over (partition by o_custkey order by o_orderdate::date range between interval 1 day following and unbounded following) as valid_to from orders)"""


@query("flt_as_of", f"with {VERSIONS_SQL} select document_id, version_id from versions where valid_from <= date '1996-06-30' and (valid_to is null or date '1996-06-30' < valid_to)")
def flt_as_of(spark: SparkSession, d: str) -> DataFrame:
    v = versions.close_previous(versions.order_versions(table(spark, d, "orders")))
    return versions.in_force(v, "1996-06-30").select("document_id", "version_id")


@query("flt_narrow_any", "select doc_id from documents where source in ('src1', 'src2') and lang in ('en', 'de')")
def flt_narrow_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("source").isin("src1", "src2") & F.col("lang").isin("en", "de")).select("doc_id")


@query("flt_file_scope", "select o_orderkey from orders where o_custkey in (1, 2, 3, 5, 8) or o_orderpriority = '1-URGENT'")
def flt_file_scope(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_custkey").isin(1, 2, 3, 5, 8) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("flt_version_pins", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
def flt_version_pins(spark: SparkSession, d: str) -> DataFrame:
    pins = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(pins, "o_orderkey", "left_semi").select("o_orderkey")


@query("flt_tenant", "select c_custkey, c_name from customer where c_nationkey = 7")
def flt_tenant(spark: SparkSession, d: str) -> DataFrame:
    return versions.for_tenant(table(spark, d, "customer"), "c_nationkey", 7).select("c_custkey", "c_name")


@query("flt_court_date", "select o_orderkey from orders where year(o_orderdate) = 1996 and month(o_orderdate) between 3 and 9 and o_orderstatus <> 'P'")
def flt_court_date(spark: SparkSession, d: str) -> DataFrame:
    in_year = (F.year("o_orderdate") == 1996) & F.month("o_orderdate").between(3, 9)
    return table(spark, d, "orders").where(in_year & (F.col("o_orderstatus") != "P")).select("o_orderkey")


@query("flt_exclude_terms", "select doc_id from documents where not contains(lower(text), 'idiot') and not contains(lower(text), 'trash')")
def flt_exclude_terms(spark: SparkSession, d: str) -> DataFrame:
    has = F.exists(F.array(F.lit("idiot"), F.lit("trash")), lambda x: F.lower("text").contains(x))
    return table(spark, d, "documents").where(~has).select("doc_id")


@query("flt_folded_like", f"select doc_id from documents where contains({FOLDED.format('text')}, 'uber') or contains({FOLDED.format('source')}, 'src7')")
def flt_folded_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(text.fold(F.col("text")).contains("uber") | text.fold(F.col("source")).contains("src7")).select("doc_id")


@query("flt_item_search", "select event_id, ts from events where event_type in ('purchase', 'error') and contains(json_extract_string(props, '$.k'), '7') order by ts desc, event_id limit 50")
def flt_item_search(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("event_type").isin("purchase", "error") & F.get_json_object("props", "$.k").contains("7")
    return table(spark, d, "events").where(hit).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")


@query("flt_iso_date_regex", r"with t as (select event_id, strftime(ts, '%Y-%m-%d') as s, user_id from events) select event_id from t where regexp_matches(case when user_id % 3 = 0 then replace(s, '-', '.') else s end, '^\d{4}-\d{2}-\d{2}$')")
def flt_iso_date_regex(spark: SparkSession, d: str) -> DataFrame:
    s = F.date_format("ts", "yyyy-MM-dd")
    mixed = F.when(F.col("user_id") % 3 == 0, F.replace(s, F.lit("-"), F.lit("."))).otherwise(s)
    return table(spark, d, "events").where(mixed.rlike(r"^\d{4}-\d{2}-\d{2}$")).select("event_id")


@query(
    "flt_boolean_text",
    """with t as (select doc_id, lower(text) as t from documents), s as (select doc_id, t, 2 * (length(t) - length(replace(t, 'of the', ''))) // 6 + (length(t) - length(replace(t, 'with', ''))) // 4 as score from t
    where contains(t, 'of the') and contains(t, 'with') and not contains(t, 'license')) select doc_id, score::bigint as score from s""",
)
def flt_boolean_text(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.boolean_text import search

    return search(table(spark, d, "documents"), [("AND", "of the", 2), ("AND", "with", 1), ("NOT", "license", 1)]).select("doc_id", F.col("score").cast("long").alias("score"))


@query("flt_injection_scan", "select doc_id from documents where regexp_matches(lower(text), 'token = \"|password|ignore (all|previous)')")
def flt_injection_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").rlike('token = "|password|ignore (all|previous)')).select("doc_id")


@query("flt_url_policy", r"select page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) as host from pages where starts_with(url, 'https://') and not regexp_matches(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), '^[0-9.]+$')")
def flt_url_policy(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)
    return table(spark, d, "pages").where(F.col("url").startswith("https://") & ~host.rlike("^[0-9.]+$")).select("page_id", host.alias("host"))


@query("flt_near_threshold", "select l_orderkey, l_linenumber from lineitem where l_discount >= 0.0 and l_tax >= 0.05")
def flt_near_threshold(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem")
    for column, least in (("l_discount", 0.0), ("l_tax", 0.05), ("l_quantity", None)):
        out = out if least is None else out.where(F.col(column) >= least)
    return out.select("l_orderkey", "l_linenumber")


@query("flt_open_deadlines", "select o_orderkey, c_name, o_orderdate from orders join customer on c_custkey = o_custkey where coalesce(nullif(o_orderstatus, 'P'), 'O') = 'O' and o_orderdate between timestamp '1996-01-01' and timestamp '1996-03-31'")
def flt_open_deadlines(spark: SparkSession, d: str) -> DataFrame:
    status = F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("O"))
    due = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz"))
    j = table(spark, d, "orders").where((status == "O") & due).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", "c_name", "o_orderdate")


@query("flt_open_hearings", "select event_id, ts, c_name from events join customer on c_custkey = user_id where event_type = 'error' and ts >= timestamp '2024-01-20' order by ts, event_id limit 40")
def flt_open_hearings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")))
    j = e.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"))
    return j.orderBy("ts", "event_id").limit(40).select("event_id", "ts", "c_name")


@query("flt_contact_search", f"select c_custkey from customer where c_mktsegment = 'BUILDING' and (contains({FOLDED.format('c_name')}, '00001') or c_custkey % 97 = 0)")
def flt_contact_search(spark: SparkSession, d: str) -> DataFrame:
    hit = text.fold(F.col("c_name")).contains("00001") | (F.col("c_custkey") % 97 == 0)
    return table(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & hit).select("c_custkey")


@query("flt_answer_list", "with t as (select l_orderkey, list(l_suppkey) as files, max(l_shipdate) as newest from lineitem group by 1) select l_orderkey, newest from t where list_contains(files, 5) order by newest desc, l_orderkey limit 30")
def flt_answer_list(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("files"), F.max("l_shipdate").alias("newest"))
    return t.where(F.array_contains("files", 5)).orderBy(F.desc("newest"), "l_orderkey").limit(30).select("l_orderkey", "newest")


@query("flt_document_search", r"select doc_id from documents where len(list_intersect(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3), ['license', 'lizenz'])) > 0 or contains(text, 'Apache')")
def flt_document_search(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("license"), F.lit("lizenz"))
    return table(spark, d, "documents").where(F.arrays_overlap(text.words(F.col("text")), wanted) | F.col("text").contains("Apache")).select("doc_id")


@query("prj_case_state", "select o_orderkey, case when o_orderstatus = 'F' and o_orderpriority is not distinct from '5-LOW' and not o_totalprice > 100000 then 'failed' else o_orderstatus end as state from orders")
def prj_case_state(spark: SparkSession, d: str) -> DataFrame:
    failed = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").eqNullSafe("5-LOW") & ~(F.col("o_totalprice") > 100000)
    return table(spark, d, "orders").select("o_orderkey", F.when(failed, "failed").otherwise(F.col("o_orderstatus")).alias("state"))


# Joins


@query("jn_inner_star", "select n_name, r_name, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1, 2")
def jn_inner_star(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


LANES_SQL = """lex as (select l_partkey as id, row_number() over (order by sum(l_quantity) desc, l_partkey) as rank from lineitem group by 1 order by sum(l_quantity) desc, l_partkey limit 100),
sem as (select p_partkey as id, row_number() over (order by p_retailprice desc, p_partkey) as rank from part order by p_retailprice desc, p_partkey limit 100)"""


def lanes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two ranked lanes over parts: by quantity sold and by price."""
    from corpusloom.operators.retrieval import ranked

    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("score"))
    price = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return ranked(sold, "score", "id", 100), ranked(price, "score", "id", 100)


@query("jn_full_outer_fuse", f"with {LANES_SQL} select coalesce(lex.id, sem.id) as id, lex.rank as lexical_rank, sem.rank as semantic_rank from lex full outer join sem on lex.id = sem.id")
def jn_full_outer_fuse(spark: SparkSession, d: str) -> DataFrame:
    a, b = lanes(spark, d)
    j = a.select("id", F.col("rank").alias("lexical_rank")).join(b.select("id", F.col("rank").alias("semantic_rank")), "id", "full")
    return j.select("id", "lexical_rank", "semantic_rank")


@query("jn_left_missing_or_stale", "select o_orderkey, case when l_orderkey is null then 'missing' else 'stale' end as state from orders left join (select l_orderkey, sum(l_quantity) as q from lineitem group by 1) on l_orderkey = o_orderkey where l_orderkey is null or q > 150")
def jn_left_missing_or_stale(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    j = table(spark, d, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("l_orderkey is null or q > 150")
    return j.select("o_orderkey", F.when(F.col("l_orderkey").isNull(), "missing").otherwise("stale").alias("state"))


@query("jn_exists_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 30)")
def jn_exists_semi(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 30")
    return table(spark, d, "orders").join(some, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("jn_not_exists_anti", f"with {VERSIONS_SQL} select distinct o.c_custkey from customer o where not exists (select 1 from versions v where v.document_id = o.c_custkey and v.valid_from <= date '1994-06-30' and (v.valid_to is null or v.valid_to > date '1994-06-30'))")
def jn_not_exists_anti(spark: SparkSession, d: str) -> DataFrame:
    v = versions.in_force(versions.close_previous(versions.order_versions(table(spark, d, "orders"))), "1994-06-30")
    return table(spark, d, "customer").join(v, F.col("c_custkey") == F.col("document_id"), "left_anti").select("c_custkey").distinct()


@query("jn_left_grouped_count", "select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def jn_left_grouped_count(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn_lateral_match", r"select doc_id, len(list_filter(['the', 'license', 'und', 'les'], lambda x: list_contains(string_split_regex(lower(text), '[^\p{L}]+'), x))) as n_matched from documents")
def jn_lateral_match(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("the", "license", "und", "les")))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_intersect(terms, text.words(F.col("text"), 1))).cast("long").alias("n_matched"))


@query("jn_lateral_pairs", "with t as (select o_orderkey, unnest([o_custkey, o_orderkey]) as key, unnest([1, 2]) as pos from orders) select o_orderkey, pos, c_name from t join customer on c_custkey = key")
def jn_lateral_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.array("o_custkey", "o_orderkey")).alias("pos", "key"))
    return t.join(table(spark, d, "customer"), F.col("key") == F.col("c_custkey")).select("o_orderkey", (F.col("pos") + 1).alias("pos"), "c_name")


@query("jn_cross_query", "with q as (select avg(o_totalprice) as mean from orders) select o_orderkey from orders, q where o_totalprice > 2 * mean")
def jn_cross_query(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "orders").agg(F.avg("o_totalprice").alias("mean"))
    return table(spark, d, "orders").crossJoin(F.broadcast(q)).where("o_totalprice > 2 * mean").select("o_orderkey")


@query("jn_as_of_version", f"with {VERSIONS_SQL}, e as (select event_id, user_id, (date '1992-01-01' + (event_id % 2400)::int)::date as at from events) select e.event_id, v.version_id from e left join versions v on v.document_id = e.user_id and v.valid_from <= e.at and (v.valid_to is null or e.at < v.valid_to)")
def jn_as_of_version(spark: SparkSession, d: str) -> DataFrame:
    v = versions.close_previous(versions.order_versions(table(spark, d, "orders")))
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("document_id"), F.expr("date_add(date'1992-01-01', cast(event_id % 2400 as int))").alias("at"))
    return versions.as_of_join(e, v, "at").select("event_id", "version_id")


@query("jn_range_overlap", "with s as (select l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber as lo, l_orderkey * 8 + l_linenumber + l_quantity::int as hi from lineitem), q as (select o_orderkey, o_orderkey * 8 as lo, o_orderkey * 8 + 2 as hi from orders) select q.o_orderkey, s.l_orderkey, s.l_linenumber from q join s on s.lo < q.hi and s.hi > q.lo")
def jn_range_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of all lines against ranges of all orders, along one axis of order numbers."""
    s = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey * 8 + l_linenumber as lo", "l_orderkey * 8 + l_linenumber + cast(l_quantity as int) as hi")
    q = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey * 8 as q_lo", "o_orderkey * 8 + 2 as q_hi")
    return versions.range_join(s, q, ("lo", "hi"), ("q_lo", "q_hi"), width=50).select("o_orderkey", "l_orderkey", "l_linenumber")


@query("jn_rate_periods", "with r(lo, hi, rate, prio) as (values (date '1990-01-01', date '1996-01-01', 5, 0), (date '1996-01-01', date '2000-01-01', 8, 0), (date '1995-06-01', date '1996-06-01', 7, 1)) select o_orderkey, rate from (select o_orderkey, rate, row_number() over (partition by o_orderkey order by prio desc) as rn from orders join r on o_orderdate::date >= lo and o_orderdate::date < hi) where rn = 1")
def jn_rate_periods(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql("select * from values (date'1990-01-01', date'1996-01-01', 5, 0), (date'1996-01-01', date'2000-01-01', 8, 0), (date'1995-06-01', date'1996-06-01', 7, 1) as t(lo, hi, rate, prio)")
    j = table(spark, d, "orders").join(F.broadcast(r), temporal.covers(F.col("lo"), F.col("hi"), F.to_date("o_orderdate")))
    return j.groupBy("o_orderkey").agg(F.max_by("rate", "prio").alias("rate"))


PAIRS_SQL = "select a.l_orderkey, a.l_linenumber as a, b.l_linenumber as b, case when a.l_quantity = b.l_quantity then 'CORROBORATION' when abs(a.l_quantity - b.l_quantity) <= 0.01 * greatest(a.l_quantity, b.l_quantity) then 'TENSION' else 'CONTRADICTION' end as verdict from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_returnflag = b.l_returnflag"


@query("jn_pairwise_theta", PAIRS_SQL)
def jn_pairwise_theta(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.analysis import pairwise

    seen = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("value"))
    return pairwise(seen, ["l_orderkey", "kind"], "seq", "value").select("l_orderkey", "a", "b", "verdict")


@query("jn_name_conflict", f"select c.c_custkey, s.s_suppkey from customer c join supplier s on right({FOLDED.format('c_name')}, 5) = right({FOLDED.format('s_name')}, 5)")
def jn_name_conflict(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.right(text.fold(F.col(c)), F.lit(5))
    c, s = table(spark, d, "customer").select("c_custkey", key("c_name").alias("k")), table(spark, d, "supplier").select("s_suppkey", key("s_name").alias("k"))
    return c.join(s, "k").select("c_custkey", "s_suppkey")


@query("jn_citator_inbound", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size = 7) order by l_shipdate desc, l_orderkey, l_linenumber limit 100")
def jn_citator_inbound(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    j = table(spark, d, "lineitem").join(seeds, "l_partkey", "left_semi")
    return j.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("jn_citator_outbound", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey % 100 = 1) order by l_shipdate desc, l_orderkey, l_linenumber limit 100")
def jn_citator_outbound(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "orders").where("o_custkey % 100 = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    j = table(spark, d, "lineitem").join(seeds, "l_orderkey", "left_semi")
    return j.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("jn_citator", "with a as (select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size = 7)), b as (select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey % 100 = 1)) select l_orderkey, l_linenumber from a union select l_orderkey, l_linenumber from b")
def jn_citator(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    cited = items.join(table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    citing = items.join(table(spark, d, "orders").where("o_custkey % 100 = 1").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return cited.select("l_orderkey", "l_linenumber").union(citing.select("l_orderkey", "l_linenumber")).distinct()


@query("jn_one_hop_expand", "select n.n_nationkey as seed, m.n_nationkey as reached from nation n join nation m on m.n_regionkey = n.n_regionkey and m.n_nationkey <> n.n_nationkey")
def jn_one_hop_expand(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("seed"), "n_regionkey"), n.select(F.col("n_nationkey").alias("reached"), "n_regionkey")
    return a.join(b, "n_regionkey").where("seed <> reached").select("seed", "reached")


@query("jn_cross_grid", "select c_custkey, r_regionkey from customer, region")
def jn_cross_grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").crossJoin(F.broadcast(table(spark, d, "region"))).select("c_custkey", "r_regionkey")


@query("jn_left_title", "select event_id, c_name as title from events left join customer on c_custkey = user_id")
def jn_left_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.col("c_name").alias("title"))


@query("jn_page_then_count", "with p as (select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40) select p.o_orderkey, (select count(*) from lineitem where l_orderkey = p.o_orderkey) as n from p")
def jn_page_then_count(spark: SparkSession, d: str) -> DataFrame:
    page = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
    items = table(spark, d, "lineitem").join(F.broadcast(page), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return page.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn_text_by_id", "select doc_id, text from documents where doc_id in (3, 30, 300)")
def jn_text_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("doc_id").isin(3, 30, 300)).select("doc_id", "text")


@query("jn_temporal_role", f"with {VERSIONS_SQL}, a as (select document_id, version_id from versions where valid_from <= date '1994-01-01' and (valid_to is null or valid_to > date '1994-01-01')), b as (select document_id, version_id from versions where valid_from <= date '1997-01-01' and (valid_to is null or valid_to > date '1997-01-01')) select b.document_id, a.version_id as was, b.version_id as now_is, a.version_id is distinct from b.version_id as changed from b left join a on a.document_id = b.document_id")
def jn_temporal_role(spark: SparkSession, d: str) -> DataFrame:
    v = versions.close_previous(versions.order_versions(table(spark, d, "orders")))
    a = versions.in_force(v, "1994-01-01").select("document_id", F.col("version_id").alias("was"))
    b = versions.in_force(v, "1997-01-01").select("document_id", F.col("version_id").alias("now_is"))
    return b.join(a, "document_id", "left").select("document_id", "was", "now_is", (~F.col("was").eqNullSafe(F.col("now_is"))).alias("changed"))


# Aggregations


@query("ag_count_by_state", "select event_type as state, count(*) as n from events group by 1")
def ag_count_by_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))


@query("ag_count_by_stage_state", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2")
def ag_count_by_stage_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("ag_filtered", "select user_id, count(*) filter (where event_type = 'error') as errors, round(coalesce(sum(value) filter (where event_type = 'purchase'), 0), 6) as spent from events group by 1")
def ag_filtered(spark: SparkSession, d: str) -> DataFrame:
    spent = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.coalesce(spent, F.lit(0.0)), 6).alias("spent"))


@query("ag_progress_grid", "select coalesce(state, 'total') as state, count(*) as n from (select case when o_orderstatus = 'F' then 'done' else 'open' end as state from orders) group by rollup(state)")
def ag_progress_grid(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state")
    return table(spark, d, "orders").select(state).rollup("state").agg(F.count("*").alias("n")).select(F.coalesce("state", F.lit("total")).alias("state"), "n")


@query("ag_tally_coverage", "select o_custkey, count(*) as units, count(*) filter (where o_orderstatus = 'F') as done, count(*) = count(*) filter (where o_orderstatus = 'F') as complete from orders group by 1")
def ag_tally_coverage(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("units"), done.alias("done"), F.bool_and(F.col("o_orderstatus") == "F").alias("complete"))


@query("ag_extraction_coverage", "select l_returnflag, sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as open, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as closed, count(distinct l_orderkey) as n_orders from lineitem group by 1")
def ag_extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_linestatus") == "F").alias("closed"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("ag_intelligence_coverage", "select l_returnflag as stage, round(sum(l_quantity), 2) as total, count(*) filter (where l_quantity > 25) as large from lineitem group by 1")
def ag_intelligence_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("ag_lane_contribution", f"with {LANES_SQL}, u as (select id, 'lexical' as lane from lex union all select id, 'semantic' from sem), s as (select id, count(*) as n from u group by 1) select lane, count(*) as hits, count(*) filter (where n = 1) as alone from u join s on s.id = u.id group by 1")
def ag_lane_contribution(spark: SparkSession, d: str) -> DataFrame:
    a, b = lanes(spark, d)
    u = a.select("id", F.lit("lexical").alias("lane")).union(b.select("id", F.lit("semantic")))
    per = u.groupBy("id").agg(F.collect_set("lane").alias("lanes")).select(F.size("lanes").alias("n"), F.explode("lanes").alias("lane"))
    return per.groupBy("lane").agg(F.count("*").alias("hits"), F.count_if(F.col("n") == 1).alias("alone"))


@query("ag_agreement_count", "select l_partkey, count(distinct l_orderkey) as n_queries, count(distinct l_suppkey) as n_subjects from lineitem group by 1")
def ag_agreement_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n_queries"), F.count_distinct("l_suppkey").alias("n_subjects"))


@query("ag_group_by_law", "select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as articles from orders group by 1")
def ag_group_by_law(spark: SparkSession, d: str) -> DataFrame:
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(keys, ",").alias("articles"))


@query("ag_stats_vectors", "select count(*) as vectors, count(*) filter (where label = 0) as stale, count(*) filter (where label is null) as missing from embeddings")
def ag_stats_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.count_if(F.col("label") == 0).alias("stale"), F.count_if(F.col("label").isNull()).alias("missing"))


@query("ag_distinct_on_latest", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def ag_distinct_on_latest(spark: SparkSession, d: str) -> DataFrame:
    latest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")
    return table(spark, d, "events").groupBy("user_id").agg(latest).select("user_id", "e.event_id", "e.event_type")


@query("ag_distinct_on_draft", "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders where o_orderstatus = 'F') where rn = 1 order by o_orderdate desc, o_custkey limit 50")
def ag_distinct_on_draft(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "orders").where("o_orderstatus = 'F'")
    top = versions.latest(drafts, ["o_custkey"], [F.desc("o_orderkey")])
    return top.orderBy(F.desc("o_orderdate"), "o_custkey").limit(50).select("o_custkey", "o_orderkey", "o_orderdate")


@query("ag_distinct_on_file", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1")
def ag_distinct_on_file(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest(table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("ag_group_candidates", "select p_brand, min(p_name) as title, count(*) as n, max(p_size) as largest from part group by 1")
def ag_group_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("title"), F.count("*").alias("n"), F.max("p_size").alias("largest"))


@query("ag_percentile", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def ag_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("ag_mean_metrics", "select round(avg(case when l_returnflag = 'R' then l_discount end), 8) as returned, round(avg(l_discount), 8) as overall from lineitem")
def ag_mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    returned = F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount")))
    return table(spark, d, "lineitem").agg(F.round(returned, 8).alias("returned"), F.round(F.avg("l_discount"), 8).alias("overall"))


@query("ag_numeric_band", "select user_id, min(value) as low, max(value) as high from events group by 1")
def ag_numeric_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query("ag_answer_band", "select l_orderkey, max(l_discount) as worst, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as ids from lineitem group by 1")
def ag_answer_band(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("worst"), ids.alias("ids"))


@query("ag_token_stats", "select event_type, count(*) as calls, round(sum(value), 4) as tokens from events group by 1")
def ag_token_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"))


@query("ag_search_groups", "with r as (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer) select c_mktsegment, count(*) as total, string_agg(c_custkey::varchar, ',' order by rn) filter (where rn <= 20) as first_ids from r group by 1")
def ag_search_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size of each group and its 20 best hits (the report's length)."""
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    totals = c.groupBy("c_mktsegment").agg(F.count("*").alias("total"))
    rn = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    top = c.withColumn("rn", rn).where("rn <= 20").groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("rn", "c_custkey"))).alias("ids"))
    ids = F.array_join(F.transform("ids", lambda x: x["c_custkey"].cast("string")), ",")
    return totals.join(top, "c_mktsegment").select("c_mktsegment", "total", ids.alias("first_ids"))


@query("ag_observation_census", "select source, count(*) filter (where quality = 1) as supported, count(*) filter (where quality = 0) as failed, count(*) filter (where quality is null) as abstained from documents left join labels using (doc_id) group by 1")
def ag_observation_census(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("supported"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("abstained"))


@query("ag_latest_amendment", r"select doc_id, list_max(list_transform(regexp_extract_all(text, '[0-9]{2,}'), lambda x: try_cast(x as decimal(38, 0))))::varchar as latest from documents")
def ag_latest_amendment(spark: SparkSession, d: str) -> DataFrame:
    """The greatest number of a text, by value; numbers of more than 38 digits do not count."""
    found = F.regexp_extract_all("text", F.lit("([0-9]{2,})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.array_max(F.transform(found, lambda x: x.try_cast("decimal(38,0)"))).cast("string").alias("latest"))


@query("ag_cell_pivot", "with c as (select o_custkey, o_orderpriority, count(*) as n, max(o_totalprice) as top from orders group by 1, 2) select o_custkey, max(top) filter (where o_orderpriority = '1-URGENT') as urgent, max(top) filter (where o_orderpriority = '2-HIGH') as high, max(top) filter (where o_orderpriority = '3-MEDIUM') as medium, max(top) filter (where o_orderpriority = '4-NOT SPECIFIED') as open, max(top) filter (where o_orderpriority = '5-LOW') as low from c group by 1")
def ag_cell_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A row a customer, a column for each of the five priorities."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "open", "5-LOW": "low"}
    grid = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderpriority", list(names)).agg(F.max("o_totalprice"))
    return grid.select("o_custkey", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


# Windows


@query("wn_pin_rank", "select l_suppkey, l_orderkey, l_linenumber, rn from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as rn from lineitem) where rn <= 3")
def wn_pin_rank(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", rn.alias("rn")).where("rn <= 3")


@query("wn_in_force", f"with {VERSIONS_SQL} select document_id, version_id from (select *, row_number() over (partition by document_id order by valid_from desc nulls last, version_id desc) as rn from versions where valid_from <= date '1997-12-31') where rn = 1")
def wn_in_force(spark: SparkSession, d: str) -> DataFrame:
    v = versions.order_versions(table(spark, d, "orders")).where("valid_from <= date'1997-12-31'")
    return versions.latest(v, ["document_id"], [F.desc_nulls_last("valid_from"), F.desc("version_id")]).select("document_id", "version_id")


@query("wn_latest_matter_version", "select l_partkey, l_orderkey from (select l_partkey, l_orderkey, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as rn from lineitem) where rn = 1")
def wn_latest_matter_version(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(newest.alias("l_orderkey"))


@query("wn_per_document_cap", "select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 3")
def wn_per_document_cap(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.retrieval import cap_per_document

    hits = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return cap_per_document(hits, "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("wn_merge_adjacent", "with t as (select o_custkey, o_orderkey, o_orderdate::date as day, o_orderstatus, case when o_orderstatus is not distinct from lag(o_orderstatus) over w then 0 else 1 end as ch from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)), g as (select *, sum(ch) over (partition by o_custkey order by day, o_orderkey) as island from t) select o_custkey, o_orderstatus, min(day) as first_day, max(day) as last_day, count(*) as n from g group by o_custkey, o_orderstatus, island")
def wn_merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    g = temporal.islands(t, ["o_custkey"], ["day", "o_orderkey"], "o_orderstatus")
    return g.groupBy("o_custkey", "o_orderstatus", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")).drop("island")


@query("wn_batching", "select o_custkey, o_orderkey, ceil(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) / 4.0)::int as batch from orders")
def wn_batching(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.ceil(rn / 4.0).cast("int").alias("batch"))


@query("wn_topk_per_claim", "select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber) as rn from lineitem) where rn <= 2")
def wn_topk_per_claim(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber"))
    return table(spark, d, "lineitem").withColumn("rn", rn).where("rn <= 2").select("l_orderkey", "l_linenumber")


@query("wn_codepoint_windows", "select doc_id, i::int as seq, substring(text, (i * 750 + 1)::int, 1000) as part from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 250) / 750.0)::int))) as i from documents)")
def wn_codepoint_windows(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 250) / 750.0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 750 + 1, F.lit(1000)))
    return table(spark, d, "documents").select("doc_id", F.posexplode(cut).alias("seq", "part"))


@query("wn_duplicate_numbering", "select c_custkey, c_mktsegment || case when row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) > 1 then '#' || row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) else '' end as label from customer")
def wn_duplicate_numbering(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey"))
    label = F.concat("c_mktsegment", F.when(rn > 1, F.concat(F.lit("#"), rn.cast("string"))).otherwise(""))
    return table(spark, d, "customer").select("c_custkey", label.alias("label"))


@query("wn_usage_hour_day", "select event_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 3600 preceding and current row) as last_hour from events")
def wn_usage_hour_day(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-3600, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("last_hour"))


# Order, limits and sets


@query("so_stable_tiebreak", "select o_orderkey from orders order by o_orderpriority, o_orderdate, o_orderkey limit 100")
def so_stable_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("so_relation_tiebreak", "select event_id from events order by coalesce(json_extract_string(props, '$.k'), ''), event_id limit 100")
def so_relation_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), "event_id").limit(100).select("event_id")


@query("so_nulls_last", "select d.doc_id from documents d left join labels l using (doc_id) order by quality desc nulls last, d.doc_id limit 100")
def so_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.orderBy(F.desc_nulls_last("quality"), "doc_id").limit(100).select("doc_id")


@query("so_case_priority", "select event_id from events order by case event_type when 'error' then 0 when 'purchase' then 1 else 2 end, event_id limit 100")
def so_case_priority(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return table(spark, d, "events").orderBy(rank, "event_id").limit(100).select("event_id")


@query("so_related_rows", "select l_orderkey, l_linenumber from lineitem order by l_returnflag, l_discount desc, l_tax desc, nullif(l_quantity, 1) desc nulls last, l_shipdate desc, l_orderkey, l_linenumber limit 100")
def so_related_rows(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_returnflag", F.desc("l_discount"), F.desc("l_tax"), F.nullif(F.col("l_quantity"), F.lit(1.0)).desc_nulls_last(), F.desc("l_shipdate"), "l_orderkey", "l_linenumber"]
    return table(spark, d, "lineitem").orderBy(*order).limit(100).select("l_orderkey", "l_linenumber")


@query("so_citations", "select l_partkey, l_suppkey, l_orderkey, l_linenumber from lineitem order by 1, 2, 3, 4 limit 100")
def so_citations(spark: SparkSession, d: str) -> DataFrame:
    columns = ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]
    return table(spark, d, "lineitem").select(*columns).orderBy(*columns).limit(100)


@query("lm_limit", "select o_orderkey from orders order by o_orderkey limit 25")
def lm_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy("o_orderkey").limit(max(1, min(25, 100))).select("o_orderkey")


@query("lm_topk_partition", "select p_partkey from part order by p_retailprice desc, p_partkey limit 20")
def lm_topk_partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey")


@query("lm_paginate_text", "select doc_id, page_no, substring(text, (page_no * 500 + 1)::int, 500) as page, pages from (select doc_id, text, ceil(length(text) / 500.0)::bigint as pages, unnest(range(0, ceil(length(text) / 500.0)::bigint)) as page_no from documents)")
def lm_paginate_text(spark: SparkSession, d: str) -> DataFrame:
    """All pages of 500 code points; they are cut before rows are made, so no text is copied."""
    pages = F.ceil(F.length("text") / 500.0)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), pages - 1), lambda i: F.substring(F.col("text"), (i * 500 + 1).cast("int"), F.lit(500)))
    t = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.posexplode(cut).alias("page_no", "page"), pages.alias("pages"))
    return t.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "page", "pages")


@query("lm_chunk_window", "select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber limit 30 offset 60")
def lm_chunk_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber").offset(60).limit(30).select("l_orderkey", "l_linenumber")


@query("st_union_dedupe", f"with {LANES_SQL} select id, min(lane) as lane from (select id, 1 as lane from lex union all select id, 2 from sem) group by 1")
def st_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    a, b = lanes(spark, d)
    u = a.select("id", F.lit(1).alias("lane")).unionByName(b.select("id", F.lit(2).alias("lane")))
    return u.groupBy("id").agg(F.min("lane").alias("lane"))


@query("st_distinct", "select distinct l_suppkey, l_returnflag from lineitem")
def st_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("st_difference", "select c_custkey from customer except select o_custkey from orders")
def st_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("st_intersection", "select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A'")
def st_intersection(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.where("l_returnflag = 'R'").select("l_partkey").intersect(t.where("l_returnflag = 'A'").select("l_partkey"))


@query("st_dedupe_key", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def st_dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
