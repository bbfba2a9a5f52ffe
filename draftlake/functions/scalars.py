"""Column functions of the match data: text keys, stable ids, series keys, dates, numbers.

NFKC and case folding have no built-in; they are Arrow functions that only see texts beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"


def stripped(text: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def is_missing(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def blank_to_null(text: Column) -> Column:
    return F.when(~is_missing(text), text)


@F.pandas_udf(T.StringType())
def _clean(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()) or None if t is not None else None)


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold() or None if t is not None else None)


def _ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*\z")


def _plain(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20]+", " ")), F.lit(""))


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def clean_label(text: Column | str) -> Column:
    """NFKC with runs of white space as one blank; null if nothing is left. Only texts that are not ASCII go to Python."""
    text = _column(text)
    return F.when(_ascii(text), _plain(text)).otherwise(_clean(F.when(~_ascii(text), text)))


def canonical_key(text: Column | str) -> Column:
    """The clean label, case-folded."""
    text = _column(text)
    return F.when(_ascii(text), F.lower(_plain(text))).otherwise(_folded(F.when(~_ascii(text), text)))


def media_url(reference: Column, kind: str) -> Column:
    """The address of an image in the kind's folder of assets; null for any other path."""
    name = F.regexp_extract(reference, rf"(?i)^assets[/\\]{kind}[/\\]([^/\\]+\.(?:png|jpe?g|webp|gif))\z", 1)
    return F.when(name != "", F.concat(F.lit(f"/api/media/{kind}/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))))


def stable_id(prefix: str, *parts: Column, length: int = 64) -> Column:
    """A prefix and the SHA-256 of the parts (null: <NULL>), cut to ``length`` characters."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("<NULL>")) for p in parts))
    return F.substring(F.concat(F.lit(prefix), F.sha2(joined, 256)), 1, length)


def is_stable_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]*\z"), F.lit(False))


def source_id_state(text: Column, most: int = 64) -> Column:
    """NONE, INVALID (padded or too long) or VALID."""
    return F.when(is_missing(text), "NONE").when((stripped(text) != text) | (F.length(text) > most), "INVALID").otherwise("VALID")


SERIES_ID = r"^(.+?)[_-]game[_-](\d+)$"
SERIES_PARAMETERS = ("series", "seriesid", "series_id", "match", "matchid")


def series_key(game_id: Column) -> Column:
    return F.nullif(F.regexp_extract(game_id, f"(?i){SERIES_ID}", 1), F.lit(""))


def series_number(game_id: Column) -> Column:
    return F.nullif(F.regexp_extract(game_id, f"(?i){SERIES_ID}", 2), F.lit("")).cast("long")


def url_parameter(url: Column, name: str) -> Column:
    """The only value of a query parameter; null if there is none or more than one distinct."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == name)
    values = F.array_distinct(F.transform(pairs, lambda p: F.substring(p, len(name) + 2, 4096)))
    return F.when(F.size(values) == 1, F.nullif(F.element_at(values, 1), F.lit("")))


def best_of(text: Column) -> Column:
    """The only best-of number a text names (bo3, best of 5); null if none or several."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:bo|best[ _-]?of[ _-]?)([135])\b"), F.lit(1)))
    return F.when(F.size(found) == 1, F.element_at(found, 1).cast("int"))


def codes(text: Column) -> Column:
    """Comma-separated codes, trimmed, distinct and sorted, as JSON."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.to_json(F.sort_array(F.array_distinct(parts)))


FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")


def timestamp(text: Column) -> Column:
    """A timestamp of any of the known formats, UTC; null if none fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))


def cutoff(start: Column) -> Column:
    """Midnight UTC of the calendar day before."""
    return F.date_trunc("DAY", start) - F.expr("INTERVAL 1 DAY")


def whole_number(text: Column) -> Column:
    """A finite, integral value of 64 bits, also when written as 1.0; else null."""
    number = text.try_cast("double")
    return F.when((number % 1 == 0) & (F.abs(number) < 2.0**63), F.coalesce(text.try_cast("bigint"), number.try_cast("bigint")))


def age_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def points(delta: Column) -> Column:
    """Percentage points of a difference of probabilities; null outside -1 to 1."""
    return F.when(F.abs(delta) <= 1, delta * 100)


def is_close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def search_words(text: Column) -> Column:
    """Words for search: lower case, without the Latin diacritics that the table knows."""
    marked = "àáâãäåạảầấậẩẫăằắặẳẵèéêëẹẻẽềếệểễìíîïịỉĩòóôõöọỏồốộổỗơờớợởỡùúûüụủũưừứựửữỳýỵỷỹđñç"
    plain = "".join({"đ": "d"}.get(c) or unicodedata.normalize("NFD", c)[0] for c in marked)
    return F.regexp_extract_all(F.translate(F.lower(text), marked, plain), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")


def slug(text: Column, most: int = 70) -> Column:
    """A file name: ASCII letters and digits with hyphens; a hash if nothing is left."""
    plain = F.trim(F.regexp_replace(F.array_join(search_words(text), "-"), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain == "", F.substring(F.sha2(text, 256), 1, 12)).otherwise(F.rtrim(F.substring(plain, 1, most), F.lit("-")))


def image_extension(head: Column) -> Column:
    """From the first bytes of a file: png, jpg, webp or gif."""
    digits = F.hex(F.substring(head, 1, 12))
    return (
        F.when(digits.startswith("89504E470D0A1A0A"), "png")
        .when(digits.startswith("FFD8FF"), "jpg")
        .when(digits.startswith("52494646") & (F.substring(digits, 17, 8) == "57454250"), "webp")
        .when(digits.startswith("47494638"), "gif")
    )
