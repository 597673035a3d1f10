"""Values in texts: dates, amounts of money, shares, durations and bare numbers, with their place.

Values are marked in the scan; only what stands between marks is counted, and a running sum of
lengths gives the offsets. Decimal commas and dots between thousands are read as in Turkish
texts. A number inside a word, a date or a longer number is no value of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Currencies as they are written and their codes, and units of time.
CURRENCIES = {"TL": "TRY", "TRY": "TRY", "₺": "TRY", "lira": "TRY", "USD": "USD", "$": "USD", "dolar": "USD", "EUR": "EUR", "€": "EUR", "avro": "EUR", "euro": "EUR"}
DURATIONS = {"gün": "day", "hafta": "week", "ay": "month", "yıl": "year", "saat": "hour"}

NUMBER = r"(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?"
DATE = r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2}"
MONEY = "|".join(c.replace("$", r"\$") for c in sorted(CURRENCIES, key=len, reverse=True))
TIME = "|".join(sorted(DURATIONS, key=len, reverse=True))
SHARE = rf"[-−]?% ?{NUMBER}|[-−]?{NUMBER} ?%"
AMOUNT = rf"[-−]?{NUMBER} ?(?:{MONEY})(?!\p{{L}})"
PERIOD = rf"{NUMBER} (?:{TIME})(?!\p{{L}})"
ANY = rf"(?<![\p{{L}}\d.,/-])(?:{DATE}|{SHARE}|{AMOUNT}|{PERIOD}|[-−]?{NUMBER})(?![\d\p{{L}}]|[.,/]\d)"


def number_of(raw: Column) -> Column:
    """The number in a value; null beyond 20 digits."""
    digits = F.regexp_extract(raw, NUMBER, 0)
    value = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(24,4)")
    return F.when(raw.rlike("^[-−]"), -value).otherwise(value)


def mapped(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def values(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row a value: key, n (from 1), start, end, kind, value, unit, day, raw.

    ``kind`` is date, share, amount, duration or number; ``unit`` a currency, a unit of time or
    a percent sign. Null texts have no values.
    """
    marked = F.split(F.regexp_replace(text, ANY, "\u0001$0\u0002"), "\u0001")
    rows = docs.select(F.col(key).alias("key"), F.posexplode(marked).alias("n", "part"))
    held = F.contains("part", F.lit("\u0002"))
    slim = rows.select("key", "n", (F.length("part") - F.when(held, 1).otherwise(0)).alias("size"), F.when(held, F.substring_index("part", "\u0002", 1)).alias("raw"))
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    found = slim.withColumn("start", F.sum("size").over(before).cast("long")).where("n > 0")
    raw = F.col("raw")
    kind = F.when(raw.rlike(f"^(?:{DATE})$"), "date").when(raw.contains("%"), "share").when(raw.rlike(rf"(?:{MONEY})$"), "amount").when(raw.rlike(rf" (?:{TIME})$"), "duration").otherwise("number")
    unit = F.when(kind == "share", "%").when(kind == "amount", mapped(CURRENCIES, F.regexp_extract(raw, rf"({MONEY})$", 1))).when(kind == "duration", mapped(DURATIONS, F.regexp_extract(raw, rf"({TIME})$", 1)))
    day = F.when(kind == "date", F.coalesce(F.try_to_date(F.translate("raw", "/", "."), "d.M.y"), F.try_to_date(raw, "y-M-d")))
    return found.select("key", "n", "start", (F.col("start") + F.length("raw")).alias("end"), kind.alias("kind"), F.when(kind != "date", number_of(raw)).alias("value"), unit.alias("unit"), day.alias("day"), "raw")
