"""Turkish stems as column expressions: endings that inflect a word are cut, the longest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings that inflect a word.
INFLECTIONS = (
    "larından lerinden larına lerine larında lerinde ların lerin lardan lerden larda lerde larla lerle ları leri lara lere lar ler "
    "sından sinden sundan sünden sında sinde sunda sünde sının sinin sunun sünün sıyla siyle suyla süyle sına sine suna süne sını sini sunu sünü "
    "ından inden undan ünden ında inde unda ünde ının inin unun ünün ıyla iyle uyla üyle ına ine una üne ını ini unu ünü "
    "ndan nden nda nde nın nin nun nün dan den tan ten yla yle ya ye yı yi yu yü da de ta te la le ın in un ün sı si su sü ım im um üm "
    "mış miş muş müş dığında diğinde dığı diği duğu düğü tığı tiği tuğu tüğü dıkça dikçe dıktan dikten dık dik duk dük tık tik tuk tük "
    "ılmış ilmiş ulmuş ülmüş ılmaz ilmez ılır ilir ulur ülür ılan ilen ulan ülen ecağı acağı ecek acak yor dır dir dur dür tır tir tur tür arak erek ıl il ul ül "
).split()
BARE_VOWELS = "ıiuüae"
# Endings that derive a word from another.
DERIVING = "lık lik luk lük cı ci cu cü çı çi çu çü ma me".split()
# Stems of light verbs and of words that frame a legal text.
STOP_STEMS = (
    "et ed edil ol olma bulun yap yapıl ver veril sayıl kıl gel gir al alın git gid kal dur bul "
    "hukuk kanun yasa madde fıkra bent hüküm hükm mevzuat düzenle düzenlen türk hâl hal durum şekil şekl"
).split()
# Final consonants that soften before a vowel, and their hard forms.
SOFT, HARD = "ğcbd", "kçpt"


#: A lazy start makes the longest ending win that leaves three letters.
INFLECTED = rf"^(.{{3,}}?)(?:{'|'.join(INFLECTIONS)})$"
BARE = rf"^(.{{4,}})[{BARE_VOWELS}]$"
DERIVED = rf"^(.{{5,}})(?:{'|'.join(DERIVING)})$"


def starts(words: list[str]) -> str:
    """A pattern of the longest of ``words`` that starts a text: letters they share are tried once."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    inner = "(?:" + "|".join(c + starts(rest) for c, rest in sorted(after.items())) + ")" if after else ""
    return inner + "?" if after and "" in words else inner


#: What three rounds cut by INFLECTED, the first by BARE too, for words read backwards: a round has
#: one try at the start instead of one at each letter, and none at a stop stem.
GOES_ON = rf"(?!(?:{'|'.join(x[::-1] for x in STOP_STEMS)})$)"
CUT = starts([x[::-1] for x in INFLECTIONS]) + "(?=.{3})"
BACKWARDS = rf"^{GOES_ON}(?:{CUT}|[{BARE_VOWELS}](?=.{{4}}))(?:{GOES_ON}{CUT}(?:{GOES_ON}{CUT})?)?"


def stem(word: Column) -> Column:
    """A lower-case word without up to three inflectional endings, its last consonant hardened.

    A bare vowel goes in the first round only, and stop stems are left as they are.
    """
    # In an array of one the stem has a name, so that it is worked out once.
    left = F.array(F.regexp_replace(F.reverse(word), BACKWARDS, ""))
    return F.transform(left, lambda w: F.reverse(F.concat(F.translate(F.substring(w, 1, 1), SOFT, HARD), F.substring(w, F.lit(2), F.length(w)))))[0]


def alternate(stemmed: Column) -> Column:
    """The stem without one deriving ending, if five letters stay; else null."""
    return F.when(stemmed.rlike(DERIVED), F.regexp_replace(stemmed, DERIVED, "$1"))


def needed_start(length: Column) -> Column:
    """Letters of a common start that a stem of this length asks for: 70 % and four at least."""
    return F.greatest(F.lit(4), F.ceil(F.lit(0.7) * length)).cast("int")


def same_lexeme(a: Column, b: Column) -> Column:
    """Equal stems, or a common start of 70 % of the shorter one and four letters at least."""
    least = F.least(F.length(a), F.length(b))
    need = needed_start(least)
    return (a == b) | ((least >= 4) & (F.substring(a, F.lit(1), need) == F.substring(b, F.lit(1), need)))


def lexeme_counts(stems: DataFrame, column: str) -> DataFrame:
    """Distinct stems of four letters or more, each with n_same and n_near if n_near is not 0.

    n_near counts the later stems (in binary order) with the same first four letters, n_same
    those of them that are ``same_lexeme``. Two stems are if they agree in the fewer letters
    that either asks for. So a stem stands under its starts of four letters up to those it asks
    for; under the longest all later stems are same, under a shorter one those that ask for no
    more. Counts come from the order under each start: no pair is made.
    """
    s = stems.where(F.length(column) >= 4).withColumn("need", needed_start(F.length(column)))
    under = s.select(column, "need", F.explode(F.sequence(F.lit(4), "need")).alias("n"))
    under = under.withColumn("start", F.substring(F.col(column), F.lit(1), F.col("n")))
    later = Window.partitionBy("start").orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    counted = under.withColumns({"all": F.count("*").over(later), "least": F.count_if(F.col("need") == F.col("n")).over(later)})
    same = F.sum(F.when(F.col("need") == F.col("n"), F.col("all")).otherwise(F.col("least")))
    return counted.groupBy(column).agg(same.alias("n_same"), F.sum(F.when(F.col("n") == 4, F.col("all")).otherwise(0)).alias("n_near")).where("n_near > 0")
