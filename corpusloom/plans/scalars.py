"""Queries for text, date and scoring functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import temporal, text, vectors
from corpusloom.plans.registry import query
from corpusloom.tables import table

TR_LOWER = "lower(translate({}, 'İI', 'iı'))"
BLANKS = r"'[ \t\n\r\x0b\f]+'"
FOLDED = "translate(lower(translate({}, 'İI', 'iı')), 'ıçğöşüâîûİI', 'icgosuaiuii')"


@query(
    "fn_tr_normalize",
    f"""select doc_id, trim(regexp_replace({TR_LOWER.format("translate(replace(text, chr(173), ''), '‐‑‒–—−‘’“”', '------' || chr(39) || chr(39) || '\"\"')")}, {BLANKS}, ' ', 'g')) as folded
    from documents""",
)
def fn_tr_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.tr_normalize(F.col("text")).alias("folded"))


@query("fn_fold_filter", f"select doc_id, source, {FOLDED.format('text')} as folded from documents")
def fn_fold_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", text.fold(F.col("text")).alias("folded"))


@query("fn_shadow_fold", f"select doc_id, length({FOLDED.format('text')}) as folded_length, length(text) as text_length from documents")
def fn_shadow_fold(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(text.fold(t)).cast("long").alias("folded_length"), F.length(t).cast("long").alias("text_length"))


@query("fn_cp_length", "select doc_id, length(text) as cp_length, length(text) = n_chars as as_stored from documents")
def fn_cp_length(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("cp_length"), (n == F.col("n_chars")).alias("as_stored"))


@query("fn_cp_slice", "select doc_id, substring(text, 11, 30) as part from documents")
def fn_cp_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.cp_slice(F.col("text"), F.lit(10), F.lit(40)).alias("part"))


@query(
    "fn_tokens",
    r"select doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3))) as n_tokens from documents",
)
def fn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    "fn_subject_key",
    r"""select item_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3)))[1:6], ' ') as subject_key
    from benchmark""",
)
def fn_subject_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(text.words(F.col("text")), 1, 6), " ").alias("subject_key"))


@query("fn_clip", "select doc_id, case when length(text) > 80 then substring(text, 1, 80) || '…' else text end as clipped from documents")
def fn_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clip(F.col("text"), 80).alias("clipped"))


@query(
    "fn_safe_text",
    rf"""with t as (select doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0e-\x1f\x7f]', '', 'g'), {BLANKS}, ' ', 'g')) as s from documents)
    select doc_id, case when length(s) > 200 then substring(s, 1, 199) || '…' else s end as safe from t""",
)
def fn_safe_text(spark: SparkSession, d: str) -> DataFrame:
    s = text.collapse(F.regexp_replace("text", "[\\x00-\\x08\\x0e-\\x1f\\x7f]", ""))
    t = table(spark, d, "documents").select("doc_id", s.alias("s"))
    return t.select("doc_id", F.when(F.length("s") > 200, F.concat(F.substring("s", 1, 199), F.lit("…"))).otherwise(F.col("s")).alias("safe"))


@query("fn_preview", "select doc_id, replace(substring(text, 1, 160), chr(10), ' ') as preview from documents")
def fn_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.replace(F.substring("text", 1, 160), F.lit("\n"), F.lit(" ")).alias("preview"))


@query("fn_sha256", "select doc_id, sha256(text) as content_sha256 from documents")
def fn_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@query("fn_det_id", "select doc_id, 'ev-' || substring(sha256(doc_id::varchar || '|0|' || n_chars::varchar), 1, 16) as evidence_id from documents")
def fn_det_id(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("0"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("ev-"), F.substring(F.sha2(key, 256), 1, 16)).alias("evidence_id"))


@query("fn_run_identity", "select doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') as run_key from documents")
def fn_run_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("run_key"))


@query(
    "fn_mask_pii",
    r"""select doc_id,
      regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}', '[PHONE]', 'g') as masked,
      len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as n_email,
      len(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) as n_phone
    from documents""",
)
def fn_mask_pii(spark: SparkSession, d: str) -> DataFrame:
    email, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
    masked = F.regexp_replace(F.regexp_replace("text", email, "[EMAIL]"), phone, "[PHONE]")
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", masked.alias("masked"), count(email).alias("n_email"), count(phone).alias("n_phone"))


TCKN_SQL = """
with n as (select c_custkey, lpad((c_custkey * 7919 % 1000000000 + 1000000000)::bigint::varchar, 10, '1') || (c_custkey % 10)::varchar as id from customer),
g as (select c_custkey, id, list_transform(range(1, 12), lambda i: substring(id, i, 1)::int) as d from n)
select c_custkey, id, ((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8]) + 1000) % 10 = d[10]
  and (d[1] + d[2] + d[3] + d[4] + d[5] + d[6] + d[7] + d[8] + d[9] + d[10]) % 10 = d[11] and id like '_%' and substring(id, 1, 1) <> '0' as valid
from g
"""


@query("fn_tckn", TCKN_SQL)
def fn_tckn(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    made = F.concat(F.lpad((key * 7919 % 1000000000 + 1000000000).cast("string"), 10, "1"), (key % 10).cast("string"))
    t = table(spark, d, "customer").select("c_custkey", made.alias("id"))
    return t.select("c_custkey", "id", text.national_id_valid(F.col("id")).alias("valid"))


@query("fn_digits", "select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as digits from customer")
def fn_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.digits(F.col("c_name")).alias("digits"))


@query("fn_vkn", "select c_custkey, length(regexp_replace(c_name, '[^0-9]', '', 'g')) = 10 as is_tax_id from customer")
def fn_vkn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", (F.length(text.digits(F.col("c_name"))) == 10).alias("is_tax_id"))


@query("fn_csv_field", """select doc_id, '"' || replace(case when regexp_matches(text, '^[=+@-]') then chr(39) || text else text end, '"', '""') || '"' as field from documents""")
def fn_csv_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.csv_field(F.col("text")).alias("field"))


@query("fn_contains_quote", "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def fn_contains_quote(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.evidence import containing

    return containing(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


@query("fn_ascii_fold", "select doc_id, regexp_replace(translate(lower(translate(text, 'İI', 'iı')), 'ıçğöşüâîûéèêëáàäíìïóòôúùñß', 'icgosuaiueeeeaaaiiiooouuns'), '[^\\x00-\\x7f]', '', 'g') as ascii from documents")
def fn_ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    plain = F.translate(text.tr_lower(F.col("text")), "ıçğöşüâîûéèêëáàäíìïóòôúùñß", "icgosuaiueeeeaaaiiiooouuns")
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(plain, "[^\\x00-\\x7f]", "").alias("ascii"))


@query("ps_predicate", "select event_id, split_part(event_type || ';' || user_id::varchar, ';', 1) as base, split_part(event_type || ';' || user_id::varchar, ';', 2) as event from events")
def ps_predicate(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat_ws(";", "event_type", F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.split_part(tag, F.lit(";"), F.lit(1)).alias("base"), F.split_part(tag, F.lit(";"), F.lit(2)).alias("event"))


@query("ps_numbers", r"select doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+(?:/[0-9]+)?'))) as n_numbers from documents")
def ps_numbers(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:/[0-9]+)?)"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_numbers"))


@query(
    "ps_abbrev_lookup",
    "with a(abbrev, full_name) as (values ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish')) select d.doc_id, a.full_name from documents d left join a on a.abbrev = d.lang",
)
def ps_abbrev_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")], "lang string, full_name string")
    return table(spark, d, "documents").join(F.broadcast(names), "lang", "left").select("doc_id", "full_name")


@query("ps_question_intent", "select conv_id, turn, case when regexp_matches(lower(text), '(^| )(what|was|que|qué|quelle?)( |$)') then 'NORM_CONTENT' else 'APPLICATION' end as intent from conversations")
def ps_question_intent(spark: SparkSession, d: str) -> DataFrame:
    asks = F.lower("text").rlike("(^| )(what|was|que|qué|quelle?)( |$)")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(asks, "NORM_CONTENT").otherwise("APPLICATION").alias("intent"))


DAY = "o_orderdate::date"


@query("dt_add_days", f"select o_orderkey, ({DAY} + 45)::date as due from orders")
def dt_add_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 45).alias("due"))


@query("dt_add_months", f"select o_orderkey, ({DAY} + interval 1 month)::date as due, day(({DAY} + interval 1 month)::date) <> day({DAY}) as clamped from orders")
def dt_add_months(spark: SparkSession, d: str) -> DataFrame:
    due, clamped = temporal.add_months_clamped(F.to_date("o_orderdate"), F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", due.alias("due"), clamped.alias("clamped"))


@query("dt_add_years", f"select o_orderkey, ({DAY} + interval 24 month)::date as due from orders")
def dt_add_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 24).alias("due"))


@query("dt_diff", "select l_orderkey, l_linenumber, date_diff('day', o_orderdate::date, l_shipdate::date)::int as days from lineitem join orders on o_orderkey = l_orderkey")
def dt_diff(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"))


@query("dt_weekday", f"select o_orderkey, (isodow({DAY}) - 1)::int as weekday, isodow({DAY}) >= 6 as weekend from orders")
def dt_weekday(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.weekday(day).alias("weekday"), temporal.is_weekend(day).alias("weekend"))


HOLIDAY = "strftime({0}, '%m-%d') in ('01-01', '04-23', '05-01', '05-19', '07-15', '08-30', '10-29')"
RECESS = "strftime({0}, '%m-%d') between '07-20' and '08-31'"


@query("dt_holidays", f"select o_orderkey, {HOLIDAY.format(DAY)} as holiday from orders")
def dt_holidays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", temporal.is_fixed_holiday(F.to_date("o_orderdate")).alias("holiday"))


@query("dt_judicial_recess", f"select o_orderkey, {RECESS.format(DAY)} as recess from orders")
def dt_judicial_recess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", temporal.in_recess(F.to_date("o_orderdate")).alias("recess"))


def next_workday_sql(day: str) -> str:
    return f"list_filter(list_transform(range(0, 15), lambda i: ({day} + i::int)::date), lambda x: isodow(x) < 6 and not ({HOLIDAY.format('x')}))[1]"


@query("dt_next_workday", f"select o_orderkey, {next_workday_sql(DAY)} as next_workday from orders union all select -e.event_id - 1, {next_workday_sql("(date '1970-01-01' + (e.event_id * 37)::int)")} from events e")
def dt_next_workday(spark: SparkSession, d: str) -> DataFrame:
    """Working days from the dates of orders, and from days of all years, one an event."""
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    days = table(spark, d, "events").select((-F.col("event_id") - 1).alias("o_orderkey"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("event_id") * 37).cast("int")).alias("day"))
    return orders.unionByName(days).select("o_orderkey", temporal.next_workday(F.col("day")).alias("next_workday"))


@query(
    "dt_deadline",
    f"""with p as (select o_orderkey, ({DAY} + 30)::date as e from orders),
    q as (select o_orderkey, case when {RECESS.format("e")} then make_date(year(e), 9, 7) else e end as e from p)
    select o_orderkey, {next_workday_sql("e")} as deadline from q""",
)
def dt_deadline(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "orders").select("o_orderkey", temporal.deadline(F.to_date("o_orderdate"), F.lit(30)).alias("day"))
    return ends.select("o_orderkey", temporal.next_workday(F.col("day")).alias("deadline"))


@query(
    "dt_sortable",
    "with t as (select o_orderkey, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d.%m.%Y') else strftime(o_orderdate, '%Y-%m-%d') end as s from orders) select o_orderkey, coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d.%m.%Y'))::date as day from t",
)
def dt_sortable(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    t = table(spark, d, "orders").select("o_orderkey", mixed.alias("s"))
    return t.select("o_orderkey", F.coalesce(F.expr("try_to_date(s, 'yyyy-MM-dd')"), F.expr("try_to_date(s, 'dd.MM.yyyy')")).alias("day"))


@query("dt_recency", "select o_orderkey, case when year(o_orderdate) >= 1997 then 1.0::double when year(o_orderdate) >= 1994 then 0.5::double else 0.25::double end as recency from orders")
def dt_recency(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.when(y >= 1997, 1.0).when(y >= 1994, 0.5).otherwise(0.25).alias("recency"))


@query(
    "dt_model_date",
    "with t as (select o_orderkey, substring(strftime(o_orderdate, '%Y-%m-%d'), 1, case o_orderkey % 3 when 0 then 4 when 1 then 7 else 10 end) as s from orders) select o_orderkey, case when length(s) = 10 then s when length(s) = 7 then s || '-01' else s || '-01-01' end as day, case when length(s) = 10 then 'day' when length(s) = 7 then 'month' else 'year' end as precision from t",
)
def dt_model_date(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    s = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), F.when(k == 0, 4).when(k == 1, 7).otherwise(10))
    t = table(spark, d, "orders").select("o_orderkey", s.alias("s"))
    full, month = F.col("s").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("s").rlike(r"^\d{4}-\d{2}$")
    day = F.when(full, F.col("s")).when(month, F.concat("s", F.lit("-01"))).otherwise(F.concat("s", F.lit("-01-01")))
    return t.select("o_orderkey", day.alias("day"), F.when(full, "day").when(month, "month").otherwise("year").alias("precision"))


@query("mt_l2norm", "select vec_id, round(list_aggregate(list_transform(embedding, lambda x: x::double * x::double), 'sum'), 6) as squared from embeddings")
def mt_l2norm(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(e, e), 6).alias("squared"))


@query(
    "mt_cosine",
    "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def mt_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(
    "mt_dot",
    "select a.vec_id as a, round(list_inner_product(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)), 6) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 2",
)
def mt_dot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("a"), F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query("mt_quantize", "select event_id, round(value * 1000)::bigint as bucket from events")
def mt_quantize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("bucket"))


@query("mt_band", "select l_orderkey, l_linenumber, case when l_discount >= 0.08 then 'near' when l_discount >= 0.04 then 'middle' else 'far' end as band from lineitem")
def mt_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", vectors.band(F.col("l_discount"), 0.08, 0.04).alias("band"))


WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '[^\p{{L}}]+'), lambda x: length(x) >= 3))"


@query(
    "mt_jaccard",
    f"with w as (select item_id, {WORDS.format('text')} as w from benchmark) select a.item_id as a, b.item_id as b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::double, 6) as jaccard from w a join w b on b.item_id = a.item_id + 1",
)
def mt_jaccard(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select("item_id", text.words(F.col("text")).alias("w"))
    after = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return w.join(after, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query(
    "mt_overlap_coef",
    f"with w as (select item_id, {WORDS.format('text')} as w from benchmark) select a.item_id as a, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::double, 6) as overlap from w a join w b on b.item_id = a.item_id + 1",
)
def mt_overlap_coef(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select("item_id", text.words(F.col("text")).alias("w"))
    after = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    share = F.size(F.array_intersect("w", "v")) / F.least(F.size("w"), F.size("v"))
    return w.join(after, "item_id").select(F.col("item_id").alias("a"), F.round(share, 6).alias("overlap"))


@query("mt_weighted_signals", "select o_orderkey, round(case when o_totalprice > 150000 then (0.6 * 1.0 + 0.4 * (o_custkey % 10) / 10.0) / 1.0 else (0.4 * (o_custkey % 10) / 10.0) / 0.4 end, 6)::double as signal from orders")
def mt_weighted_signals(spark: SparkSession, d: str) -> DataFrame:
    semantic = F.when(F.col("o_totalprice") > 150000, F.lit(1.0))
    lexical = (F.col("o_custkey") % 10) / 10.0
    total = F.coalesce(0.6 * semantic, F.lit(0.0)) + 0.4 * lexical
    weight = F.when(semantic.isNotNull(), 0.6).otherwise(0.0) + 0.4
    return table(spark, d, "orders").select("o_orderkey", F.round(total / weight, 6).alias("signal"))


@query("mt_relevance", "select l_orderkey, l_linenumber, round(0.4 * l_discount * 10 + 0.2 * l_tax * 10 + 0.25 * (l_linenumber / 7.0) + 0.1 * (l_quantity / 50) + 0.05, 4)::double as relevance from lineitem")
def mt_relevance(spark: SparkSession, d: str) -> DataFrame:
    blend = 0.4 * F.col("l_discount") * 10 + 0.2 * F.col("l_tax") * 10 + 0.25 * (F.col("l_linenumber") / 7.0) + 0.1 * (F.col("l_quantity") / 50) + F.lit(0.05)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(blend, 4).alias("relevance"))


@query("mt_hybrid_alpha", "select l_orderkey, l_linenumber, round(0.7 * l_discount + (1 - 0.7) * l_tax, 6)::double as blended from lineitem")
def mt_hybrid_alpha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(0.7 * F.col("l_discount") + 0.3 * F.col("l_tax"), 6).alias("blended"))


@query("mt_span_iou", "select l_orderkey, l_linenumber, round(case when least(l_partkey + 50, l_suppkey * 10 + 50) > greatest(l_partkey, l_suppkey * 10) then (least(l_partkey + 50, l_suppkey * 10 + 50) - greatest(l_partkey, l_suppkey * 10)) / (greatest(l_partkey + 50, l_suppkey * 10 + 50) - least(l_partkey, l_suppkey * 10))::double else 0 end, 6) as iou from lineitem")
def mt_span_iou(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey") * 10
    shared, hull = F.least(a + 50, b + 50) - F.greatest(a, b), F.greatest(a + 50, b + 50) - F.least(a, b)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(shared > 0, shared / hull).otherwise(0.0), 6).alias("iou"))


@query("mt_round_money", "select l_orderkey, l_linenumber, round((l_extendedprice * (1 - l_discount))::decimal(18,6), 2)::double as net from lineitem")
def mt_round_money(spark: SparkSession, d: str) -> DataFrame:
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(net, 2).cast("double").alias("net"))


FEE_SQL = "greatest(round(o_totalprice::decimal(18,2) * 0.06831, 2)::decimal(18,2), 500::decimal(18,2))"


@query("mt_fees", f"select o_orderkey, {FEE_SQL}::double as fee, round({FEE_SQL} * 0.25, 2)::double as advance, o_totalprice > 200000 as above_limit from orders")
def mt_fees(spark: SparkSession, d: str) -> DataFrame:
    """Per-mille fee with a floor on the fee; the advance is a quarter."""
    rate, quarter = F.lit("0.06831").cast("decimal(6,5)"), F.lit("0.25").cast("decimal(3,2)")
    fee = F.greatest(F.round(F.col("o_totalprice").cast("decimal(18,2)") * rate, 2).cast("decimal(18,2)"), F.lit(500).cast("decimal(18,2)"))
    return table(spark, d, "orders").select("o_orderkey", fee.cast("double").alias("fee"), F.round(fee * quarter, 2).cast("double").alias("advance"), (F.col("o_totalprice") > 200000).alias("above_limit"))


@query("mt_minmax", "select l_orderkey, l_linenumber, round(coalesce((l_extendedprice - min(l_extendedprice) over (partition by l_orderkey)) / nullif(max(l_extendedprice) over (partition by l_orderkey) - min(l_extendedprice) over (partition by l_orderkey), 0), 1), 6) as scaled from lineitem")
def mt_minmax(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    lo, hi = F.min("l_extendedprice").over(w), F.max("l_extendedprice").over(w)
    scaled = F.when(hi > lo, (F.col("l_extendedprice") - lo) / (hi - lo)).otherwise(1.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scaled, 6).alias("scaled"))


INTEREST_SQL = """
with r(lo, hi, rate) as (values (date '1990-01-01', date '1995-01-01', 9.0::double), (date '1995-01-01', date '1997-06-01', 12.0::double), (date '1997-06-01', null, 24.0::double)),
s as (select o_orderkey, o_totalprice, greatest(o_orderdate::date, lo) as a, least(date '1999-01-01', coalesce(hi, date '2100-01-01')) as b, rate from orders, r)
select o_orderkey, round(sum(o_totalprice * rate * date_diff('day', a, b) / 36500.0), 2) as interest, sum(date_diff('day', a, b))::bigint as days
from s where a < b group by o_orderkey
"""


@query("mt_interest", INTEREST_SQL)
def mt_interest(spark: SparkSession, d: str) -> DataFrame:
    """Interest by period: each order meets the rate periods that overlap it."""
    rates = spark.sql("select * from values (date'1990-01-01', date'1995-01-01', 9.0D), (date'1995-01-01', date'1997-06-01', 12.0D), (date'1997-06-01', null, 24.0D) as t(lo, hi, rate)")
    held = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("start"), F.lit("1999-01-01").cast("date").alias("end"))
    met = held.join(F.broadcast(rates), temporal.overlaps(F.col("start"), F.col("end"), F.col("lo"), F.coalesce("hi", F.lit("2100-01-01").cast("date"))))
    days = F.datediff(F.least("end", F.coalesce("hi", F.lit("2100-01-01").cast("date"))), F.greatest("start", "lo"))
    return met.groupBy("o_orderkey").agg(F.round(F.sum(F.col("o_totalprice") * F.col("rate") * days / 36500.0), 2).alias("interest"), F.sum(days).cast("long").alias("days"))
