"""Texts to claims: sentences, then contrast and semicolon parts, with code-point offsets. Columns only.

White space and word ends are those of Unicode. A sentence ends after signs that white space or the text's end
follows. One with a word of cause stays whole; else it is cut at its first contrast, or else at its semicolons.
Time follows a text's length: offsets are summed in steps, and each sentence is split once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoss.functions.scalars import date_precision

# The words and signs that end sentences and link claims.
END = r"[.!?]+"
CAUSAL = "so|therefore|because|thus|hence"
CONTRAST = "but|although|however"

_SENTENCE = rf"(?sU).*?(?:{END}(?=\s|\z)|\z)"
_CAUSE = rf"(?iuU)\b(?:{CAUSAL})\b"
_TURN = rf"(?iuU),\s*({CONTRAST})\s+"
_PAUSE = r"(?U);\s+"
_STEP = 128  # lengths that are summed in one go


def _piece(start: Column, text: Column) -> Column:
    """(start, text) with white space off both ends."""
    left = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.struct((start + F.length(text) - F.length(left)).alias("start"), F.regexp_replace(left, r"(?U)\s+\z", "").alias("text"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column) -> Column:
    """Running sums of lengths, each before its own: of _STEP at a time, from the sum of all steps before.

    A fold copies its state at each element, so none holds more than a step.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    state = lambda at, new: F.struct(at.alias("at"), new.alias("new"))

    def run(xs: Column, base: Column) -> Column:
        zero = state(base, F.array().cast("array<int>"))
        return F.aggregate(xs, zero, lambda acc, n: state(acc["at"] + n, F.concat(acc["new"], F.array(acc["at"]))), lambda acc: acc["new"])

    def steps(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_STEP)), lambda i: F.slice(xs, i, _STEP))
        return _let(cut, lambda parts: _let(F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, lambda p, k: run(p, total(F.slice(sums, 1, k)))))))

    return _let(lengths, steps)


def sentences(text: Column) -> Column:
    """Array of (index, start, text) of the sentences that are not blank."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)), lambda x: x != "")
    placed = F.zip_with(parts, _starts(F.transform(parts, lambda x: F.length(x))), lambda t, a: _piece(a, t))
    return F.transform(F.filter(placed, lambda x: x["text"] != ""), lambda x, i: F.struct(i.alias("index"), x["start"].alias("start"), x["text"].alias("text")))


def split_once(s: Column) -> Column:
    """A sentence with what its claims are made of, so that each pattern is run once."""
    body = s["text"]
    return F.struct(s["index"].alias("index"), s["start"].alias("start"), body.alias("text"), body.rlike(_CAUSE).alias("cause"), F.split(body, _TURN, 2).alias("turn"), F.regexp_extract_all(body, F.lit(_PAUSE), F.lit(0)).alias("pauses"))


def claims_of(s: Column) -> Column:
    """Array of claims of one ``split_once``: (sentence_index, claim_index, start, text, linking_term, link_type)."""

    def claim(i: Column, piece: Column, term: Column, kind: str) -> Column:
        return F.struct(s["index"].alias("sentence_index"), i.cast("int").alias("claim_index"), piece["start"].alias("start"), piece["text"].alias("text"), term.alias("linking_term"), F.lit(kind).alias("link_type"))

    body, turn, pauses, none = s["text"], s["turn"], s["pauses"], F.lit("")
    left, right = F.get(turn, F.lit(0)), F.get(turn, F.lit(1))
    term = F.lower(F.regexp_extract(body, _TURN, 1))
    contrast = F.array(claim(F.lit(0), _piece(s["start"], left), term, "contrast_left"), claim(F.lit(1), _piece(s["start"] + F.length(body) - F.length(right), right), term, "contrast_right"))
    parts = F.split(body, _PAUSE)
    spans = F.zip_with(parts, pauses, lambda p, q: F.length(p) + F.coalesce(F.length(q), F.lit(0)))
    cut = F.filter(F.zip_with(parts, _starts(spans), lambda t, a: _piece(s["start"] + a, t)), lambda x: x["text"] != "")
    semicolons = F.transform(cut, lambda x, i: claim(i, x, F.lit(";"), "semicolon_part"))
    whole = F.array(claim(F.lit(0), F.struct(s["start"].alias("start"), body.alias("text")), none, "whole_sentence"))
    return F.when(s["cause"], whole).when(F.size(turn) > 1, contrast).when(F.size(pauses) > 0, semicolons).otherwise(whole)


def segment(reviews: DataFrame, text: str = "review_text", position: str = "input_row_position", date: str = "review_date", prefix: str = "REVIEWS") -> DataFrame:
    """One row per claim, with its key, offsets, hash and date precision beside the review's columns."""
    claims = F.flatten(F.transform(F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), split_once), claims_of))
    got = reviews.select("*", F.posexplode(claims).alias("__n", "__c"))
    key: Column = F.format_string(f"{prefix}:r%06d:c%03d", F.col(position).cast("long"), F.col("__n"))
    return got.select(*[F.col(f"`{c}`") for c in reviews.columns], key.alias("claim_id"), F.col("__c.sentence_index"), F.col("__c.claim_index"), F.col("__c.text").alias("claim_text"), F.sha2("__c.text", 256).alias("claim_text_sha256"), F.col("__c.start").alias("source_text_start"), (F.col("__c.start") + F.length("__c.text")).alias("source_text_end"), F.col("__c.linking_term"), F.col("__c.link_type"), date_precision(F.col(date).cast("string")).alias("date_precision"))
