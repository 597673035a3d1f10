"""Queries on notices, parties and petitions.

The tables hold no letters, so Spark writes them: an order is a notice to its customer, its
items are the paragraphs of a petition. The SQL takes the fields from the columns, not from the
text, so what the operators read must be what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import amounts, notices
from corpusloom.plans.registry import query
from corpusloom.tables import table


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows that become long texts, dealt over all tasks; AQE would join them by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)


def notice_texts(spark: SparkSession, d: str) -> DataFrame:
    """A notice an order: a third names two days of service, a fifth tells it in a sentence only."""
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "dd.MM.yyyy")
    k = F.col("o_orderkey")
    served = F.when(k % 5 == 0, F.concat(F.lit("Karar "), day(10), F.lit(" tarihinde tebliğ edilmiştir.\n"))).otherwise(F.concat(F.lit("Tebliğ Tarihi : "), day(10), F.lit("\n")))
    again = F.when((k % 3 == 0) & (k % 5 != 0), F.concat(F.lit("Tebellüğ tarihi: "), F.date_format(F.date_add("o_orderdate", 11), "yyyy-MM-dd"), F.lit("\n"))).otherwise("")
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = spread(joined.select("o_orderkey", "o_orderdate", "c_name", "c_mktsegment"), "o_orderkey")
    text = F.concat(
        F.lit("T.C.\nMahkemesi: Ankara "), (k % 9 + 1).cast("string"), F.lit(". Asliye Hukuk\nESAS NO: "), F.year("o_orderdate").cast("string"), F.lit("/"), k.cast("string"), F.lit(" E.\nDavacı: Av. "),
        F.col("c_name"), F.lit("\nDavalı (borçlu): Sayın "), F.col("c_mktsegment"), F.lit(" Ltd. Şti.\nVekili: Av. Ayşe Kaya\n"), served, again, F.lit("Süre: "), (k % 3 * 7 + 7).cast("string"), F.lit(" gün\nBaşvuran: "), F.col("c_name"), F.lit("\n"),
    )
    return joined.select("o_orderkey", text.alias("text"))


NOTICE_SQL = "j as (select * from orders join customer on o_custkey = c_custkey)"


@query(
    "ps_notice",
    f"with {NOTICE_SQL}, f as (select o_orderkey, 'court' as field, 'Ankara ' || (o_orderkey % 9 + 1) || '. Asliye Hukuk' as value, 'stated' as status, 1 as n_candidates from j "
    "union all select o_orderkey, 'file_number', year(o_orderdate) || '/' || o_orderkey, 'stated', 1 from j union all select o_orderkey, 'period', (o_orderkey % 3 * 7 + 7)::varchar, 'stated', 1 from j "
    "union all select o_orderkey, 'service_date', case when o_orderkey % 3 <> 0 or o_orderkey % 5 = 0 then strftime(o_orderdate::date + 10, '%Y-%m-%d') end, case when o_orderkey % 3 <> 0 or o_orderkey % 5 = 0 then 'stated' else 'conflict' end, case when o_orderkey % 3 <> 0 or o_orderkey % 5 = 0 then 1 else 2 end from j) select * from f",
)
def ps_notice(spark: SparkSession, d: str) -> DataFrame:
    """Fields of every notice; contradicting days of service are a conflict without a value."""
    found = notices.settled_fields(notice_texts(spark, d), "o_orderkey").select("key", F.inline("fields"))
    return found.select(F.col("key").alias("o_orderkey"), "field", "value", "status", "n_candidates")


@query(
    "ps_parties",
    rf"with {NOTICE_SQL} select o_orderkey, regexp_replace(lower(c_name), '[^\p{{L}}\p{{N}}]+', ' ', 'g') as party, 'Av. ' || c_name as name, 'davaci,basvuran' as roles, 'claimant' as side from j "
    "union all select o_orderkey, lower(c_mktsegment) || ' ltd sti', 'Sayın ' || c_mktsegment || ' Ltd. Şti', 'davali (borclu)', 'defendant' from j union all select o_orderkey, 'ayse kaya', 'Av. Ayşe Kaya', 'vekil', 'unknown' from j",
)
def ps_parties(spark: SparkSession, d: str) -> DataFrame:
    """Parties of every notice; who is named twice has both roles."""
    found = notices.parties(notice_texts(spark, d), "o_orderkey")
    return found.select(F.col("key").alias("o_orderkey"), "party", "name", F.array_join("roles", ",").alias("roles"), "side")


ROLES = ["Davacı", "DAVALI", "Davalı-karşı davacı", "davacılar ve davalı", "Müdahil", "Alacaklı vekili", "tanık"]


@query(
    "ps_party_side",
    f"select o_orderkey, ['claimant', 'defendant', 'defendant', 'unknown', 'intervener', 'claimant', 'unknown'][(o_orderkey % {len(ROLES)} + 1)::int] as side from orders",
)
def ps_party_side(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("o_orderkey") % len(ROLES) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", notices.party_side(role).alias("side"))


def petition_texts(spark: SparkSession, d: str) -> DataFrame:
    """A petition an order: its items are numbered facts, its price the relief; odd ones answer."""
    item = lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit("- Mal "), r["l_partkey"].cast("string"), F.lit(" teslim edilmiştir.\nAdet "), r["l_quantity"].cast("int").cast("string"), F.lit(" idi."))
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    facts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(items, item), "\n").alias("facts"))
    kind = F.when(F.col("l_orderkey") % 2 == 1, "CEVAP DİLEKÇESİ").otherwise("DAVA DİLEKÇESİ")
    text = F.concat(kind, F.lit("\n1. önce gelen satır\n\nAÇIKLAMALAR :\n"), F.col("facts"), F.lit("\nHUKUKİ NEDENLER\n1. TBK\nSONUÇ VE İSTEM:\n1) Ödeme istenir.\n\nson satır"))
    return facts.select("l_orderkey", text.alias("text"))


@query(
    "ps_claims",
    "with i as (select l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as n from lineitem), "
    "c as (select l_orderkey, n as claim, 'facts' as section, l_linenumber as number, 'Mal ' || l_partkey || ' teslim edilmiştir. Adet ' || l_quantity::int || ' idi.' as statement from i union all select l_orderkey, max(n) + 1, 'relief', 1, 'Ödeme istenir.' from i group by 1) "
    "select l_orderkey, claim::int as claim, section, number::int as number, case when l_orderkey % 2 = 1 then 'defendant' else 'claimant' end as side, statement from c",
)
def ps_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of every petition with their section and side."""
    found = notices.claims(petition_texts(spark, d), "l_orderkey")
    return found.select(F.col("key").alias("l_orderkey"), "claim", "section", "number", "side", "statement")


@query(
    "ps_docket_fields",
    f"with {NOTICE_SQL} select o_orderkey, 'Ankara ' || (o_orderkey % 9 + 1) || '. Asliye Hukuk' as court, year(o_orderdate) || '/' || o_orderkey as file_number, case when o_orderkey % 3 = 0 and o_orderkey % 5 <> 0 then 'service_date' else '' end as conflicts from j",
)
def ps_docket_fields(spark: SparkSession, d: str) -> DataFrame:
    """Court and file number of every notice, a row each."""
    found = notices.docket(notice_texts(spark, d), "o_orderkey")
    return found.select(F.col("key").alias("o_orderkey"), "court", "file_number", F.array_join("conflicts", ",").alias("conflicts"))


def statement_texts(spark: SparkSession, d: str) -> DataFrame:
    """A statement of account an order, with a value of every kind."""
    tr = lambda x: F.translate(F.format_number(x, 2), ",.", ".,")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("Sözleşme No A"), k.cast("string"), F.lit(" uyarınca bedel "), tr(F.col("o_totalprice")), F.lit(" TL olup, "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" tarihinde %"), (k % 40).cast("string"),
        F.lit(",5 faizle "), (k % 28 + 1).cast("string"), F.lit(" gün içinde ödenir; iade −"), tr((k % 5000).cast("double")), F.lit(" USD, ek "), k.cast("string"), F.lit(" adet."),
    )
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query(
    "ps_values",
    "select o_orderkey, 1 as n, 'amount' as kind, round(o_totalprice, 2)::double as value, 'TRY' as unit, null::date as day from orders union all select o_orderkey, 2, 'date', null, null, o_orderdate::date from orders "
    "union all select o_orderkey, 3, 'share', o_orderkey % 40 + 0.5, '%', null from orders union all select o_orderkey, 4, 'duration', o_orderkey % 28 + 1, 'day', null from orders "
    "union all select o_orderkey, 5, 'amount', -(o_orderkey % 5000), 'USD', null from orders union all select o_orderkey, 6, 'number', o_orderkey, null, null from orders",
)
def ps_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of every statement: money with its currency and sign, shares, durations, dates, numbers."""
    found = amounts.values(statement_texts(spark, d), "o_orderkey")
    return found.select(F.col("key").alias("o_orderkey"), F.col("n"), "kind", F.col("value").cast("double").alias("value"), "unit", "day")
