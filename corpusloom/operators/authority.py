"""Authority, outcome and stance of passages by fixed rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import tr_normalize

# Tiers of authority; words in a court's name, sources, and the score.
TIERS: list[tuple[int, float, list[str], list[str]]] = [
    (2, 0.95, ["anayasa mahkemesi"], ["AYM"]),
    (3, 0.9, ["içtihadı birleştirme", "içtihatları birleştirme"], []),
    (4, 0.8, ["yargıtay", "danıştay"], []),
    (5, 0.65, ["bölge adliye", "bölge idare", "istinaf", "asliye", "sulh", "ağır ceza", "idare mahkemesi", "vergi mahkemesi", "iş mahkemesi"], []),
    (6, 0.55, ["kurul"], ["KVKK", "REKABET", "BDDK", "BTK", "KIK", "SAYISTAY", "GIB", "SIGORTA"]),
]
# Phrases of a negative and of an affirmative outcome, and stems of statute types.
NEGATIVE = [
    "unsurları oluşmadığ", "unsurlarının oluşmadığ", "unsurları oluşmamış", "unsurlarının oluşmamış", "suçun unsurları oluşmad",
    "oluşmadığı hakkında", "suç oluşmaz", "suçu oluşmaz", "oluşturmadığ", "uygulanmaz", "beraat", "davanın reddine", "istemin reddine",
    "talebin reddi", "talebinin reddi", "şikayetin reddine", "başvurunun reddine", "iptal isteminin reddi", "ihlal bulunmadığ",
    "aykırılık bulunmadığ", "kusuru bulunmadığ", "delil bulunmamakta", "hukuki nitelikte", "bozulmasına", "kabul edilemez", "aksi yönde",
]
AFFIRMATIVE = [
    "suçunu oluşturduğ", "suçu oluşturduğ", "oluşturduğu kabul", "oluşturduğ", "unsurları oluşmuş", "unsurlarının oluştuğ", "kabul edilmelidir",
    "ihlal edildiğ", "ihlal ettiğ", "kabulüne", "mahkumiyetine", "mahkûmiyetine", "cezalandırılmasına",
]
STATUTE_TYPES = "kanun khk kararname tüzük tuzuk yönetmelik yonetmelik tebliğ teblig genelge mevzuat anayasa".split()


def holds(text: Column, phrases: list[str]) -> Column:
    return F.regexp_like(text, F.lit("|".join(phrases)))


def authority(source: Column, court: Column, law: Column) -> tuple[Column, Column]:
    """Tier (1 a statute to 7 unknown) and score of a source."""
    name = tr_normalize(F.coalesce(court, F.lit("")))
    tier = F.when((F.upper(source) == "MEVZUAT") | (law.isNotNull() & (name == "")), 1)
    for n, _, words, sources in TIERS:
        tier = tier.when(holds(name, words) | F.upper(source).isin(sources), n)
    tier = tier.otherwise(7)
    score = F.element_at(F.array(*[F.lit(x) for x in (1.0, *[t[1] for t in TIERS], 0.4)]), tier)
    return tier, score


def polarity(text: Column) -> Column:
    """NEGATIVE or AFFIRMATIVE by the phrases of an outcome, the negative first; else NEUTRAL."""
    read = lambda t: F.when(holds(t, NEGATIVE), "NEGATIVE").when(holds(t, AFFIRMATIVE), "AFFIRMATIVE").otherwise("NEUTRAL")
    # In an array of one the plain text has a name, so that it is worked out once.
    return F.get(F.transform(F.array(tr_normalize(text)), read), F.lit(0))


def stance(kind: Column, text: Column) -> Column:
    """How a passage stands to a claim; statutes are always neutral."""
    side = lambda p: F.when(p == "NEGATIVE", "contrary").when(p == "AFFIRMATIVE", "supporting").otherwise("neutral")
    read = F.get(F.transform(F.array(polarity(text)), side), F.lit(0))
    return F.when(holds(tr_normalize(kind), STATUTE_TYPES), "neutral").otherwise(read)
