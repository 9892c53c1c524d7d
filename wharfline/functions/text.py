"""Text functions: folding, recognition, redaction, coercion."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the recognisers accept.
PART_NUMBER = r"\b[A-Z]{2,4}-\d{4,6}\b"
NUMBER = r"^[-+]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?$"
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
SLASH_DATE_LONG = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
SLASH_DATE_SHORT = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"
DAY_MONTH_YEAR = r"^([0-9]{1,2})\s+([A-Za-z]{3,9})\s+([0-9]{4})$"
MONTH_DAY_YEAR = r"^([A-Za-z]{3,9})\s+([0-9]{1,2}),\s*([0-9]{4})$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PIVOT = 68
SECRETS = r"(?i)\b(password|token|api[_-]?key|secret)\s*[=:]\s*\S+"
LABELLED = r"^([^:]{1,60}):(.*)$"
PAGE_ANCHOR = r"\|\s*Page\s+\d+\s+of\s+\d+\s*$"


def part_numbers(text: Column) -> Column:
    """Part numbers in a text, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PART_NUMBER), F.lit(0)))


def blank(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\r\f\x0b")) == ""


def folded(text: Column) -> Column:
    """Lower case, white space collapsed; see ``nfc`` for composed characters."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


@F.pandas_udf(T.StringType())
def folded_label(text: pd.Series) -> pd.Series:
    """The form that two labels are compared in: composed, case-folded, white space collapsed."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def uuid5(name: pd.Series) -> pd.Series:
    """Name-based id in the URL namespace."""
    return name.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)))


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, "$1=[redacted]")


def slug(text: Column) -> Column:
    """An id minted from a name: lower case, runs of other characters as one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def number(printed: Column) -> Column:
    """A printed number as a decimal; null unless the whole text is one, grouped in threes if at all."""
    bare = F.trim(printed)
    return F.when(bare.rlike(NUMBER), F.regexp_replace(bare, "[,+]", "").cast("decimal(38,10)"))


def _valid(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def date(printed: Column) -> Column:
    """A printed date; the first form that fits decides, month first with slashes, two-digit years from 1969 to 2068."""
    bare = F.trim(printed)
    part = lambda sep, i: F.try_element_at(F.split(bare, sep), F.lit(i)).try_cast("int")
    month_of = lambda name: F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: (m == F.lower(name)) | (F.substring(m, 1, 3) == F.lower(name))), F.lit(True)).cast("int")
    short = part("/", 3)
    year = F.when(short <= PIVOT, 2000 + short).otherwise(1900 + short)
    at = lambda pattern, i: F.regexp_extract(bare, pattern, i)
    return (
        F.when(bare.rlike(ISO_DATE), _valid(part("-", 1), part("-", 2), part("-", 3)))
        .when(bare.rlike(SLASH_DATE_LONG), _valid(part("/", 3), part("/", 1), part("/", 2)))
        .when(bare.rlike(SLASH_DATE_SHORT), _valid(year, part("/", 1), part("/", 2)))
        .when(bare.rlike(DAY_MONTH_YEAR), _valid(at(DAY_MONTH_YEAR, 3).try_cast("int"), month_of(at(DAY_MONTH_YEAR, 2)), at(DAY_MONTH_YEAR, 1).try_cast("int")))
        .when(bare.rlike(MONTH_DAY_YEAR), _valid(at(MONTH_DAY_YEAR, 3).try_cast("int"), month_of(at(MONTH_DAY_YEAR, 1)), at(MONTH_DAY_YEAR, 2).try_cast("int")))
    )


# Fixed value: the shape of the provider's credential.
CREDENTIAL = r"sk-ant-[A-Za-z0-9_-]{16,}"


def redacted_leaves(payload: Column, configured: str | None = None) -> Column:
    """A nested payload as JSON with every credential replaced, in keys and values at any depth; the configured one first, whatever its shape."""
    body = F.to_json(payload)
    if configured:
        body = F.replace(body, F.lit(configured), F.lit("[REDACTED]"))
    return F.regexp_replace(body, CREDENTIAL, "[REDACTED]")


def canonical_json(cells: dict[str, Column]) -> Column:
    """An object as JSON with its keys in order and no spaces; a null keeps its key."""
    return F.to_json(F.struct(*(cells[k].alias(k) for k in sorted(cells))), {"ignoreNullFields": "false"})


#: Levels of brackets that a fixture may have.
MOST_LEVELS = 32


def json_refusal(body: Column, most_levels: int = MOST_LEVELS) -> Column:
    """Why a fixture's JSON is refused, null if it is not: byte-order mark, malformed, not an object, float, too deep.

    A number with a point or an exponent is a float: its digest would depend on who prints it.  Texts inside the JSON
    are taken out before brackets and numbers are looked at.  Keys that repeat in one object are malformed; a null body too.
    """
    bare = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', '""')
    steps = F.transform(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    levels = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("top")), lambda a, s: F.struct((a["at"] + s).alias("at"), F.greatest(a["top"], a["at"] + s).alias("top")))["top"]
    return (
        F.when(F.startswith(body, F.lit("\ufeff")), "byte-order mark")
        .when(F.try_parse_json(body).isNull(), "malformed")
        .when(~bare.rlike(r"^\s*\{"), "not an object")
        .when(bare.rlike("[0-9][.eE]"), "float")
        .when(levels > most_levels, "too deep")
    )


def rfc3339(at: Column) -> Column:
    """A time in UTC, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalized_name(name: Column, punctuation: str = ",.") -> Column:
    """A name for comparison: lower case, without the punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), punctuation, ""), r"\s+", " "))
