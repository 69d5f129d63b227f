"""Language codes as literal map expressions (no join, stays in codegen)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 639-2 to 639-1 for the languages discs carry.
THREE_TO_TWO = dict(
    eng="en", fra="fr", fre="fr", spa="es", ger="de", deu="de", ita="it", por="pt",
    jpn="ja", kor="ko", zho="zh", chi="zh", ara="ar", rus="ru", nld="nl", dut="nl",
    swe="sv", dan="da", nor="no", fin="fi", pol="pl", ces="cs", cze="cs", hun="hu",
    tur="tr", tha="th", vie="vi", ind="id",
)

# ISO 639-1 to 639-2 for navigation language codes.
TWO_TO_THREE = dict(
    en="eng", fr="fra", es="spa", de="deu", it="ita", pt="por", nl="nld", ja="jpn",
    ru="rus", zh="zho", ko="kor", sv="swe", da="dan", fi="fin", no="nor", pl="pol",
    cs="ces", hu="hun", el="ell", tr="tur", ar="ara", he="heb", hi="hin", th="tha",
)

# The two-letter codes in use, and those withdrawn with their successors.
CURRENT = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy "
    "da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht "
    "hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky "
    "la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny "
    "oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn so sq sr "
    "ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi "
    "yo za zh zu"
).split()
WITHDRAWN = {"in": "id", "iw": "he", "ji": "yi", "jw": "jv", "mo": "ro"}

# Language words looked for in track descriptions, first hit wins.
DESCRIPTION_WORDS = [
    ("brazilian portuguese", "por"),
    ("portuguese", "por"),
    ("english", "eng"),
    ("french", "fra"),
    ("spanish", "spa"),
    ("german", "deu"),
    ("italian", "ita"),
    ("japanese", "jpn"),
    ("dutch", "nld"),
    ("russian", "rus"),
    ("chinese", "zho"),
    ("korean", "kor"),
]


def lookup(mapping: dict, key: Column, default: Column) -> Column:
    """Dimension lookup with a default, as a literal map."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, key), default)


def two_letter(code: Column) -> Column:
    return lookup(THREE_TO_TWO, code, code)


def three_letter(code: Column) -> Column:
    return lookup(TWO_TO_THREE, F.lower(code), F.lit("und"))


def norm_lang(code: Column) -> Column:
    """A current two-letter code, with withdrawn ones replaced; anything else ``und``."""
    lowered = F.lower(code)
    current = lookup(WITHDRAWN, lowered, lowered)
    return F.when(current.isin(CURRENT), current).otherwise("und")


def describe_track(description: Column) -> Column:
    """Struct of language, forced, commentary and hearing-impaired read off a text."""
    text = F.lower(F.coalesce(description, F.lit("")))
    language = F.coalesce(
        *[F.when(F.contains(text, F.lit(word)), F.lit(code)) for word, code in DESCRIPTION_WORDS],
        F.lit("und"),
    )
    impaired = ["sdh", "hard of hearing", "hearing impaired"]
    sdh = F.contains(text, F.lit(impaired[0]))
    for phrase in impaired[1:]:
        sdh = sdh | F.contains(text, F.lit(phrase))
    return F.struct(
        language.alias("lang"),
        F.contains(text, F.lit("forced")).alias("forced"),
        F.contains(text, F.lit("commentary")).alias("commentary"),
        sdh.alias("sdh"),
    )
