"""Actor names and classification codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from techatlas.functions.text import _col, split_list

# Legal-form suffixes cut off the end of an actor name.
LEGAL_FORMS = [
    "CO LTD", "LTD", "INC", "CORP", "CORPORATION", "GMBH", "AG", "SA", "SAS", "SE", "NV", "BV",
    "KK", "AB", "OY", "AS", "PLC", "LLC", "PTY", "& CO KG", "KG",
]


def legal_form_pattern() -> str:
    """One suffix at the end. The leftmost match is the longest suffix, so order is free."""
    return "( " + "| ".join(LEGAL_FORMS) + ")$"


def normalize_actor_name(c: Column | str) -> Column:
    upper = F.trim(F.upper(_col(c)))
    bare = F.replace(F.replace(upper, F.lit("."), F.lit("")), F.lit(","), F.lit(""))
    return F.trim(F.regexp_replace(_without_legal_form(bare), r"\s+", " "))


def _without_legal_form(name: Column) -> Column:
    """What the pattern does, by comparing endings: names are many, and the pattern is tried at each of their blanks.

    Names that end in anything but a digit or a capital are left to the pattern, which passes over a final line break.
    """
    cut = F
    for form in sorted(LEGAL_FORMS, key=len, reverse=True):
        cut = cut.when(F.endswith(name, F.lit(f" {form}")), F.left(name, F.char_length(name) - len(form) - 1))
    plain = F.substring(name, -1, 1).between("0", "Z")
    return F.when(plain, cut.otherwise(name)).otherwise(F.regexp_replace(name, legal_form_pattern(), ""))


def merge_key(c: Column | str) -> Column:
    """Key under which actors of both sources are merged."""
    return F.upper(F.trim(_col(c)))


def normalize_code(c: Column | str, level: int = 4) -> Column:
    return F.substring(F.replace(F.trim(_col(c)), F.lit(" "), F.lit("")), 1, level)


def code_set(c: Column | str, level: int = 4) -> Column:
    """Distinct codes of a comma separated list, cut to ``level`` characters, sorted."""
    return F.array_sort(
        F.array_distinct(F.transform(split_list(c), lambda x: normalize_code(x, level)))
    )


def parse_pub_date(c: Column | str) -> Column:
    """YYYYMMDD to ISO; anything else stays as it is."""
    raw = _col(c)
    return F.when(
        F.length(raw) == 8,
        F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)),
    ).otherwise(raw)


def year_of(c: Column | str) -> Column:
    """Year of an ISO date text, null if the first four characters are no number."""
    return F.substring(_col(c), 1, 4).try_cast("int")


NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def safe_float(c: Column | str) -> Column:
    """Plain and scientific decimal numbers; anything else (also 1.5d, NaN, Infinity) is null."""
    text = F.trim(_col(c))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def framework_from_filename(c: Column | str) -> Column:
    name = F.lower(_col(c))
    return (
        F.when(name.contains("fp7"), "FP7")
        .when(name.contains("h2020"), "H2020")
        .when(name.contains("horizon"), "HORIZON")
        .otherwise("UNKNOWN")
    )


# The entities every XML parser knows by name (character references begin with #).
XML_NAMES = "amp lt gt apos quot".split()
#: A reference by a name that is none of these.
ENTITY_PATTERN = rf"&(?!(?:{'|'.join(XML_NAMES)});)\p{{Alpha}}\p{{Alnum}}*;"


def sanitize_entities(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), ENTITY_PATTERN, "")
