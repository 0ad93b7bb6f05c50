"""Scalar functions as Column expressions; no Python runs on executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MISSING = ("", "nan", "None", "NaN")
SIGNS = r"""[\s.,;:!?()\[\]{}"']"""


def sha256_text(c: Column) -> Column:
    return F.sha2(c, 256)


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", "") == "", F.lit(True))


def missing(c: Column) -> Column:
    """Null or one of the strings that stand for a missing id."""
    return c.isNull() | c.cast("string").isin(*MISSING)


def number(c: Column) -> Column:
    """A double, or null where the text is no plain decimal number."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def packed(c: Column) -> Column:
    """The non-empty parts of an ``a;b`` list, untrimmed; null: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")


def packed_scores(c: Column) -> Column:
    """Numbers after the last colon of each part of an ``a:0.5;b:-1`` list; other parts are skipped.

    ``nan`` counts as zero and ``inf`` by its sign.
    """
    tails = F.transform(F.filter(packed(c), lambda x: F.contains(x, F.lit(":"))), lambda x: F.trim(F.substring_index(x, ":", -1)))
    value = lambda x: F.when(F.lower(x).rlike(r"^[+-]?nan$"), 0.0).when(F.lower(x).rlike(r"^\+?inf(inity)?$"), 1.0).when(F.lower(x).rlike(r"^-inf(inity)?$"), -1.0).otherwise(number(x))
    return F.filter(F.transform(tails, value), lambda v: v.isNotNull())


def packed_labels(c: Column) -> Column:
    """Signs of the labels positive, negative and neutral after the last colon of each part."""
    tails = F.transform(packed(c), lambda x: F.lower(F.trim(F.substring_index(x, ":", -1))))
    sign = lambda x: F.when(x == "positive", 1.0).when(x == "negative", -1.0).when(x == "neutral", 0.0)
    return F.filter(F.transform(tails, sign), lambda v: v.isNotNull())


def sentiment_class(c: Column) -> Column:
    """mixed, positive, negative, neutral or unknown, of a packed list of scores."""
    s = packed_scores(c)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    both = F.exists(s, lambda x: x < 0) & F.exists(s, lambda x: x > 0)
    return F.when(F.size(s) == 0, "unknown").when(both, "mixed").when(total > 0, "positive").when(total < 0, "negative").otherwise("neutral")


def to_date(c: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM")) -> Column:
    """A timestamp by the first format that fits, else null."""
    text = c.cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def year_label(d: Column) -> Column:
    return F.coalesce(F.year(d).cast("string"), F.lit("NaT"))


def quarter_label(d: Column) -> Column:
    return F.coalesce(F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")), F.lit("NaT"))


def date_precision(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "day").when(c.rlike(r"^\d{4}-\d{2}"), "month").otherwise("unknown")


def date_precision_with_year(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "day").when(c.rlike(r"^\d{4}-\d{2}"), "month").when(c.rlike(r"^\d{4}"), "year").otherwise("unknown")


def slug(c: Column, most: int = 80, strip_left: bool = True) -> Column:
    """A file-name stem: other characters to _, cut, plus 12 digits of the id's hash."""
    stem = F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")
    stem = F.substring(F.regexp_replace(stem, "^_+|_+$", ""), 1, most) if strip_left else F.regexp_replace(F.substring(stem, 1, most), "_+$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(c, 256), 1, 12))


def below(path: str, folder: str) -> Column:
    """A file's path relative to the folder, from its full address."""
    root = "".join("\\" + c if not c.isalnum() and c != "/" else c for c in folder.rstrip("/"))
    return F.regexp_replace(path, f"^.*?{root}/", "")


def token_estimate(c: Column) -> Column:
    """At least one token, else characters over 3.6, rounded down."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / F.lit(3.6))).cast("long")


def token_estimate_quarter(chars: Column) -> Column:
    """A quarter of the characters, halves to even."""
    return F.bround(chars / F.lit(4.0), 0).cast("long")


def canonical_category(c: Column, specs: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first category one of whose aliases stands in the text as a whole word, in any case."""
    import re

    text = F.coalesce(c, F.lit(""))
    hits = [F.when(text.rlike(r"(?iu)(?U)(?<!\w)(?:%s)(?!\w)" % "|".join(re.escape(a) for a in aliases)), name) for name, aliases in specs]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def clean_term(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SIGNS}+|{SIGNS}+$", "")


def sentiment_of_label(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(x)), x) for x in ("positive", "negative", "neutral")])


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)) if terms else F.lit(False)


def tokens_forbidden(c: Column, forbidden: Sequence[str]) -> Column:
    """Whether a whole token of the name (split at signs, any case) is forbidden."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "_")
    return F.arrays_overlap(parts, F.array(*[F.lit(x.lower()) for x in forbidden])) if forbidden else F.lit(False)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(F.greatest(dot(a, a), F.lit(1e-24)) * F.greatest(dot(b, b), F.lit(1e-24)))


def finite(c: Column) -> Column:
    """Every number of a vector is finite."""
    return ~F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def model_json(c: Column, schema: str) -> Column:
    """The outermost braces of a model's answer as a struct; null where they do not parse."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)
