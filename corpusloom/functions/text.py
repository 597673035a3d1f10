"""Column expressions on text. All offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the Turkish alphabet and their plain forms.
FOLD_FROM = "ıçğöşüâîûİI"
FOLD_TO = "icgosuaiuii"


def tr_lower(text: Column) -> Column:
    """Lower case by Turkish rules, without a change of length for dotted capitals."""
    return F.lower(F.translate(text, "İI", "iı"))


def collapse(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\u000b\f]+", " "))


def tr_normalize(text: Column) -> Column:
    """Drop soft hyphens, unify dashes and quotes, lower by Turkish rules, collapse blanks."""
    plain = F.regexp_replace(text, "­", "")
    plain = F.translate(plain, "‐‑‒–—−‘’“”", "------''\"\"")
    return collapse(tr_lower(plain))


def fold(text: Column) -> Column:
    """Lower case without diacritics; as long as its input."""
    return F.translate(tr_lower(text), FOLD_FROM, FOLD_TO)


def cp_slice(text: Column, start: Column, end: Column) -> Column:
    """Code points [start, end)."""
    return F.substring(text, start + 1, end - start)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def national_id_valid(text: Column) -> Column:
    """Eleven digits, no leading zero, both check digits right."""
    d = [F.substring(text, i + 1, 1).cast("int") for i in range(11)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == d[9]
    last = F.pmod(odd + even + d[9], F.lit(10)) == d[10]
    return F.when(text.rlike("^[1-9][0-9]{10}$"), tenth & last).otherwise(F.lit(False))


def words(text: Column, least: int = 3) -> Column:
    """Distinct lower-case runs of letters with at least ``least`` of them, sorted."""
    parts = F.split(F.lower(text), r"[^\p{L}]+")
    return F.sort_array(F.array_distinct(F.filter(parts, lambda x: F.length(x) >= least)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of words; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def clip(text: Column, n: int, marker: str = "…") -> Column:
    """The text, or its first n code points and a marker if it is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def csv_field(text: Column) -> Column:
    """Quoted CSV field; a leading formula sign is made harmless."""
    safe = F.when(text.rlike("^[=+\\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))
    return (gone / F.lit(len(term))).cast("int")
