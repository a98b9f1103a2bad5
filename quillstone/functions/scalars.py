"""Scalar functions over columns. All are built-in expressions but Jaro-Winkler and the sequence ratio, which Spark lacks."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NULL_TOKENS = ("", "null", "none")  # blank foreign keys
ID_NULL_TOKENS = ("", "null", "none", "n/a", "nan")  # invalid identifiers


def is_blank(c: Column, tokens: tuple[str, ...] = ("",)) -> Column:
    """Null, or one of the tokens once trimmed and lower-cased. Each operator names its own token set."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*tokens)


def normalize_value(c: Column) -> Column:
    """Trimmed, lower-cased, with runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are the same."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays, as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams in order; none for a text shorter than n."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def common_prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common prefix by that of the longer text."""
    longer = F.greatest(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.when(longer == 0, F.lit(1.0)).when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0)).otherwise(F.size(same) / longer)


def snake_case(c: Column) -> Column:
    parted = F.regexp_replace(F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(parted, r"[\s\-]+", "_"))


def pascal_case(c: Column) -> Column:
    return F.replace(F.initcap(F.regexp_replace(c, r"[_\s\-]+", " ")), F.lit(" "), F.lit(""))


def camel_case(c: Column) -> Column:
    whole = pascal_case(c)
    return F.concat(F.lower(F.substring(whole, 1, 1)), F.substr(whole, F.lit(2)))


def char_class(c: Column) -> Column:
    """What a value is made of."""
    return (
        F.when(c.isNull() | (c == ""), "EMPTY")
        .when(c.rlike(r"^[0-9]+$"), "NUMERIC")
        .when(c.rlike(r"^\p{Lu}+$"), "UPPER")
        .when(c.rlike(r"^\p{Ll}+$"), "LOWER")
        .when(c.rlike(r"^\p{L}+$"), "MIXED_CASE")
        .when(c.rlike(r"^\p{L}[\p{L}0-9]*$"), "ALNUM")
        .when(c.rlike(r"^[0-9][\p{L}0-9]*$"), "NUM_ALPHA")
        .when(c.rlike(r"^[\p{L}0-9]+([-_./:][\p{L}0-9]+)+$"), "WITH_SEPARATOR")
        .when(c.rlike(r"\s"), "WITH_SPACE")
        .otherwise("SPECIAL")
    )


def structure_mask(c: Column) -> Column:
    """A for capitals, a for small letters, 9 for digits; the rest as it is."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")


#: Patterns of the value types that profiling recognises.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\d\s\-\+\(\)]{7,20}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}",
    "url": r"^https?://[^\s]+$",
    "code": r"^[A-Z]{2,5}[-_]?\d{2,10}$",
    "numeric_id": r"^\d{1,20}$",
}


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(PATTERNS[pattern])


def numeric_string(c: Column) -> Column:
    """Number in a text, thousands separators allowed; null if it is none."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "yyyyMMdd")


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window that holds a time, counted from the epoch in UTC."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 if either is all zeros."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def logit(c: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1.0 - p))


def change(c: Column, kind: str, value: float) -> Column:
    """The change kinds of scenarios: set, add, multiply, percentage."""
    kinds = {"set": lambda: F.lit(float(value)), "add": lambda: c + value, "multiply": lambda: c * value, "percentage": lambda: c * (1 + value / 100.0)}
    if kind not in kinds:
        raise ValueError(f"a change is one of {sorted(kinds)}, not {kind}")
    return kinds[kind]()


def wildcard(pattern: str) -> str:
    """A regular expression for an event name pattern: * is one dotted segment, and alone it is everything."""
    if pattern == "*":
        return ".*"
    return "^" + "\\.".join("[^.]+" if p == "*" else p.replace("$", "\\$") for p in pattern.split(".")) + "$"


#: SQL types and the XML schema types that stand for them.
XSD_TYPES = {"string": "xsd:string", "bigint": "xsd:integer", "int": "xsd:integer", "smallint": "xsd:integer", "double": "xsd:decimal", "float": "xsd:decimal", "boolean": "xsd:boolean", "date": "xsd:date", "timestamp": "xsd:dateTime", "timestamp_ntz": "xsd:dateTime"}


def xsd_type(spark_type: str) -> str:
    return XSD_TYPES.get(spark_type.split("(")[0], "xsd:decimal" if spark_type.startswith("decimal") else "xsd:string")


def uri(namespace: str, c: Column) -> Column:
    return F.concat(F.lit(namespace), F.regexp_replace(c.cast("string"), r"[^A-Za-z0-9_\-.]", "_"))


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two texts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, picked = [False] * len(b), []
    for i, letter in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == letter:
                taken[j] = True
                picked.append(letter)
                break
    if not picked:
        return 0.0
    swaps = sum(x != y for x, y in zip(picked, (y for y, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    m = len(picked)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_text(a: str | None, b: str | None, weight: float = 0.1, boost_from: float = 0.0) -> float | None:
    if a is None or b is None:
        return None
    found = jaro(a, b)
    if found <= boost_from:
        return found
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return found + prefix * weight * (1 - found)


@F.pandas_udf(DoubleType())
def jaro_winkler(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([jaro_winkler_text(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio of two texts."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def json_in_text(c: Column) -> Column:
    """The JSON object or list inside a text: code fences gone, from the first bracket to the last, without commas before a closing one; null if it cannot be read."""
    plain = F.regexp_replace(c, r"```[a-zA-Z]*", "")
    inner = F.regexp_extract(plain, r"(?s)(\{.*\}|\[.*\])", 1)
    mended = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    return F.when((inner != "") & F.try_parse_json(mended).isNotNull(), mended)
