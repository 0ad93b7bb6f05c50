"""A corpus pipeline of five stages; each is written as Parquet and read again by the next.

All stages but the last return the columns of their input, in its order; extra columns come through, whatever their
names. Every stage reads whole texts, however long, gives no row for an empty table, and treats each of several
repeated rows by itself, save where one of a group of copies is meant to stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm import op1_language_id as language
from veridoss.llm.op3_mixing import mix_sources
from veridoss.llm.op5_ngram_join import keep_one_per_component
from veridoss.llm.op6_secrets import redact
from veridoss.llm.op10_packing import pack
from veridoss.llm.queries import domain_of, tokenizer_path
from veridoss.llm.shared import bounded_batches, keep

SLOT_BITS = 20  # of the token table, beside what earlier stages left in an executor
MIX_SHARE = 0.9  # of the tokens that reach the mixing stage


def private(docs: DataFrame) -> DataFrame:
    """docs under names that no operator gives its results, so that extra columns of any name come through."""
    return docs.withColumnsRenamed({c: f"doc__{c}" for c in docs.columns})


def public(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``private`` renamed, under their own names again."""
    return docs.select(*[F.col(f"`doc__{c}`").alias(c) for c in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lang becomes the identified language.

    Null and empty texts, and texts without letters, are rejected. A null language, source or id is no reason to reject:
    a null language declares nothing, a null source has no prior of its own.
    """
    bounded_batches(spark)
    model = language.train(docs, "text", "lang")
    out = language.identify(spark, private(docs), model, "doc__text", F.col("doc__lang"), F.col("doc__source"))
    return public(out.where("identified_lang <> 'und'").withColumn("doc__lang", F.col("identified_lang")), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more, the one with the smallest id stays.

    Texts shorter than five words are one shingle. Null texts and texts without words are linked with nothing and all stay.
    Of rows that repeat an id, one stays; rows with a null id cannot be linked and all stay.
    """
    return keep_one_per_component(spark, docs, k=5, threshold_pct=80).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span gives way to a mark; all documents stay.

    Null and empty texts stay as they are. n_chars follows a text that changes. Overlapping spans give way to one mark.
    """
    bounded_batches(spark)
    return redact(spark, docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token-prefix of each (domain, language, source) under tempered weights, once at most.

    A null language or source is a node of its own; null and empty texts count as one token. Rows that share an id, or
    have none, share a hash and are taken or left together.
    """
    names = {"id_col": "doc__doc_id", "text_col": "doc__text", "lang_col": "doc__lang", "source_col": "doc__source"}
    return public(mix_sources(spark, private(docs), domain_of(F.col("doc__source")), share=MIX_SHARE, epochs=1, **names), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    Null and empty texts are a piece of the end id alone. Null ids are kept; repeated rows are packed as often as they occur.
    """
    return pack(spark, docs, tokenizer_path("word_bpe_49k.json"), slot_bits=SLOT_BITS)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language model, the randomness tests nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(spark, stage(spark, docs, sf_dir), name)
    return docs
