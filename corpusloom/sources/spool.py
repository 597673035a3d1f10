"""Readers and writers for document files: JSON spools, CSV, calendars, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.arrowmap import give_back
from corpusloom.functions.text import csv_field
from corpusloom.grouping import spans

DOCUMENT = "source string, external_id string, document_type string, title string, retrieved_url string, media_type string, dates map<string,string>, text string"

#: JSON texts of any length are read, beyond the parser's 20,000,000 characters.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}

#: Fields of an OCR row.
OCR_FIELDS = 12
#: Fields of an OCR row that give a word's place on its page.
OCR_KEYS = ["block", "par", "line", "word"]
#: Stands for a missing number, below all others.
NO_KEY = -(2**31) - 1


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON documents, one object a file."""
    return spark.read.schema(DOCUMENT).options(**ANY_LENGTH).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line."""
    return spark.read.schema(schema).options(**ANY_LENGTH).json(path)


def read_spool(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and refused ones with ``reason``, of a spool of JSON lines."""
    raw = spark.read.text(path).withColumn("record", F.from_json("value", DOCUMENT, ANY_LENGTH))
    r = F.col("record")
    reason = (
        F.when(r.isNull() | (r["source"].isNull() & r["external_id"].isNull() & r["text"].isNull()), "NOT_JSON")
        .when(F.coalesce(r["source"], F.lit("")) == "", "NO_SOURCE")
        .when(F.coalesce(r["external_id"], F.lit("")) == "", "NO_ID")
        .when(F.trim(F.coalesce(r["text"], F.lit(""))) == "", "NO_TEXT")
    )
    marked = raw.withColumn("reason", reason)
    return marked.where("reason is null").select("record.*"), marked.where("reason is not null").select("value", "reason")


def insert_new(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def resync(rows: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Difference of two tables by key: added, removed, changed or same."""
    a = rows.select(*keys, F.col(value).alias("new"), F.lit(True).alias("has_new"))
    b = stored.select(*keys, F.col(value).alias("old"), F.lit(True).alias("has_old"))
    state = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(F.col("new").eqNullSafe(F.col("old")), "same").otherwise("changed")
    return a.join(b, keys, "full").withColumn("state", state).drop("has_new", "has_old")


def _numbers(texts: pa.Array, kind: pa.DataType, strict: bool) -> pa.Array:
    """Numbers of texts; blanks around them and a plus sign do not disturb, others fail, or are null unless ``strict``."""
    try:
        return texts.cast(kind)
    except pa.ArrowInvalid:
        plain = pc.replace_substring_regex(pc.ascii_trim(texts, " \t\r\n\f\v"), r"^\+([0-9.])", r"\1")
        if not strict:
            shape = r"^-?[0-9]{1,9}$" if pa.types.is_integer(kind) else r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
            plain = pc.if_else(pc.match_substring_regex(plain, shape), plain, pa.scalar(None, texts.type))
        return plain.cast(kind)


def page_pieces(lines: pa.Array, least: float, strict: bool) -> pa.RecordBatch | None:
    """The sure words of OCR rows by page, in order: one row a run of words of one page.

    A word holds no tab, as tabs part the fields, so tabs part the words of a piece.
    """
    parts = pc.split_pattern(lines.drop_null(), "\t")
    at, size = np.asarray(parts.offsets)[:-1], np.diff(np.asarray(parts.offsets))
    if strict and len(size) and size.min() < OCR_FIELDS:
        raise ValueError(f"an OCR row has {size.min()} fields, not {OCR_FIELDS}")
    at = at[size >= OCR_FIELDS]
    field = lambda i: parts.values.take(pa.array(at + i))
    conf, text = _numbers(field(10), pa.float64(), strict), field(11)
    sure = np.asarray(conf.fill_null(-np.inf))
    sure = (sure >= least) | np.isnan(sure)
    sure &= np.asarray(conf.is_valid()) & np.asarray(pc.not_equal(pc.ascii_trim(text, " "), ""))
    at = at[sure]
    if not len(at):
        return None
    row = pa.RecordBatch.from_arrays([*[_numbers(field(i), pa.int32(), strict) for i in range(1, 6)], conf.filter(pa.array(sure)), text.filter(pa.array(sure))], ["page", *OCR_KEYS, "conf", "text"])
    page, *keys = [np.asarray(row[n].cast(pa.int64()).fill_null(NO_KEY)) for n in ("page", *OCR_KEYS)]
    if not _ascending([page, *keys]):
        order = pc.sort_indices(row, sort_keys=[(n, "ascending") for n in ("page", *OCR_KEYS, "text")], null_placement="at_start")
        row, page = row.take(order), page[np.asarray(order)]
    starts, ends = spans(page)
    cuts = pa.array(np.append(starts, len(page)), pa.int32())
    by_page = lambda n: pa.ListArray.from_arrays(cuts, row[n])
    edge = lambda i: pa.StructArray.from_arrays([row[n].take(pa.array(i)) for n in OCR_KEYS], OCR_KEYS)
    total = np.add.reduceat(np.asarray(row["conf"]), starts)
    columns = [row["page"].take(pa.array(starts)), edge(starts), edge(ends - 1), pa.array(ends - starts), pa.array(total), *map(by_page, OCR_KEYS), pc.binary_join(by_page("text"), "\t")]
    return pa.RecordBatch.from_arrays(columns, ["page", "low", "high", "n", "total", *OCR_KEYS, "words"])


def _ascending(keys: list[np.ndarray]) -> bool:
    """Whether each row of the key columns is above the one before it."""
    above = np.zeros(len(keys[0]) - 1, bool)
    for k in reversed(keys):
        above = (k[1:] > k[:-1]) | ((k[1:] == k[:-1]) & above)
    return bool(above.all())


def ocr_words(tsv: DataFrame, least: float = 0.0) -> DataFrame:
    """Text and mean confidence by page of OCR rows (value: 12 tab-separated fields).

    Words are put together where they are read, so that pieces of pages are shuffled and
    sorted, not words. Only pages whose pieces overlap, as when their rows are dealt over
    several files, are sorted by word.
    """
    strict = tsv.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    key = "struct<" + ", ".join(f"{n}: int" for n in OCR_KEYS) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = page_pieces(batch.column(0), least, strict)
            if made is not None:
                yield made
        give_back()

    pieces = tsv.select("value").mapInArrow(run, f"page int, low {key}, high {key}, n bigint, total double, " + ", ".join(f"{n} array<int>" for n in OCR_KEYS) + ", words string")
    held = F.sort_array(F.collect_list(F.struct("low", "high", "words", *OCR_KEYS))).alias("p")
    pages = pieces.groupBy("page").agg(held, (F.sum("total") / F.sum("n")).alias("confidence"))
    p = F.col("p")
    apart = F.forall(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i - 1)["high"] < F.get(p, i)["low"]))
    joined = F.replace(F.array_join(F.transform(p, lambda x: x["words"]), "\t"), F.lit("\t"), F.lit(" "))
    words = F.flatten(F.transform(p, lambda x: F.arrays_zip(*[x[n].alias(n) for n in OCR_KEYS], F.split(x["words"], "\t").alias("text"))))
    merged = F.array_join(F.transform(F.sort_array(words), lambda w: w["text"]), " ")
    return pages.select("page", F.when(apart, joined).otherwise(merged).alias("text"), "confidence")


def manifest(files: DataFrame) -> DataFrame:
    """Path, length and SHA-256 of files read with the binaryFile source."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV lines with every field quoted and formula signs made harmless."""
    line = F.concat_ws(",", *[csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def fold_line(line: F.Column, width: int = 75) -> F.Column:
    """A calendar line cut to ``width`` characters, continued lines led by a blank."""
    n = F.greatest(F.lit(0), F.ceil((F.length(line) - width) / F.lit(float(width - 1)))).cast("int")
    rest = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(" "), F.substring(line, (i - 1) * (width - 1) + width + 1, F.lit(width - 1)))))
    return F.array_join(F.concat(F.array(F.substring(line, 1, width)), F.coalesce(rest, F.array().cast("array<string>"))), "\r\n")


def calendar_feed(df: DataFrame, uid: str, day: str, title: str) -> DataFrame:
    """One calendar event a row, as text in column value."""
    clean = F.regexp_replace(F.regexp_replace(F.col(title), r"([\\;,])", r"\\$1"), "\n", r"\\n")
    parts = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), fold_line(F.concat(F.lit("SUMMARY:"), clean)), F.lit("END:VEVENT")]
    return df.select(F.concat_ws("\r\n", *parts).alias("value"))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, ``value``: the frame as a Markdown table; for reports of bounded size."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    lines = F.array_sort(F.collect_list(F.struct(*order, row.alias("__line"))))
    return df.agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(lines, lambda x: x["__line"]), "\n")).alias("value"))
