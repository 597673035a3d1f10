"""References to statutes, articles and decisions in texts, as column expressions.

Covered are numbered statutes, the abbreviations below, articles and the file and decision
numbers of courts; gazettes and names spelled out without a number are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations of statutes and their numbers.
NUMBERS = {"TCK": "5237", "TBK": "6098", "TMK": "4721", "HMK": "6100", "CMK": "5271", "İİK": "2004", "TTK": "6102", "KVKK": "6698", "VUK": "213"}
LAW = r"[0-9]{3,4} sayılı(?: [A-ZÇĞİÖŞÜ][a-zçğıöşü]+)* Kanun[a-zçğıöşü]*"
SHORT = rf"(?:{'|'.join(NUMBERS)})\b"
ARTICLE = r"(?:m\.|md\.|[Mm]adde) ?[0-9]+(?:/[0-9]+)?"
FILE, DECISION = r"E\. ?[0-9]{4}/[0-9]+", r"K\. ?[0-9]{4}/[0-9]+"
ANY = "|".join([LAW, SHORT, ARTICLE, FILE, DECISION])


def references(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row a reference: key, n (from 1), start, end (code points), kind, number, law number."""
    marked = F.regexp_replace(F.col(text), f"({ANY})", "\u0001$1\u0002")
    parts = docs.where(F.col(text).rlike(ANY)).select(key, F.split(marked, "\u0001").alias("parts"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,name:string>>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        name = F.when(F.contains(p, F.lit("\u0002")), F.substring_index(p, "\u0002", 1))
        found = F.when(name.isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(s["at"].alias("start"), name.alias("name")))))
        return F.struct((s["at"] + F.length(p) - F.when(name.isNull(), 0).otherwise(1)).alias("at"), found.alias("found"))

    rows = parts.select(key, F.posexplode(F.aggregate("parts", first, step)["found"]).alias("n", "r")).select(key, (F.col("n") + 1).alias("n"), "r.*")
    kind = F.when(F.col("name").rlike(f"^{LAW}"), "law").when(F.col("name").rlike(f"^{SHORT}"), "law").when(F.col("name").rlike(f"^{ARTICLE}"), "article").when(F.col("name").rlike(f"^{FILE}"), "file").otherwise("decision")
    number = F.coalesce(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])[F.col("name")], F.regexp_extract("name", "[0-9]+(?:/[0-9]+)?", 0))
    return rows.select(key, "n", "start", (F.col("start") + F.length("name")).alias("end"), kind.alias("kind"), number.alias("number"))


def outbound(found: DataFrame, key: str) -> DataFrame:
    """Each statute with the article that follows it before the next statute: key, n, law, article."""
    w = Window.partitionBy(key).orderBy("n")
    own = found.where(F.col("kind").isin("law", "article"))
    own = own.withColumns({"next_kind": F.lead("kind").over(w), "next_number": F.lead("number").over(w)}).where("kind = 'law'")
    return own.select(key, "n", F.col("number").alias("law"), F.when(F.col("next_kind") == "article", F.col("next_number")).alias("article"))


def canonical(text: Column) -> Column:
    """Mentions of statutes by their number alone."""
    plain = F.regexp_replace(text, rf"([0-9]{{3,4}}) sayılı(?: [A-ZÇĞİÖŞÜ][a-zçğıöşü]+)* Kanun[a-zçğıöşü]*", "$1")
    for short, number in NUMBERS.items():
        plain = F.regexp_replace(plain, rf"(^|[^\p{{L}}]){short}\b", f"$1{number}")
    return plain
