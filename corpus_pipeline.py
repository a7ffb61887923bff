"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

In every stage null and empty texts are texts without words, repeated rows are rows of their own, null ids come last among equals,
an empty table gives an empty one, long texts are handled as a whole, and columns besides those of `documents` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import language, neardup, packing, quality, suffix_dedup
from lodestrata.llm.common import drop_paths, load, materialize, work_path, work_tables

#: A document whose n-grams its best language holds to a smaller share than this has no language that is known here.
LEAST_LANGUAGE_SHARE = 0.25
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Null and empty texts, texts without letters and unknown languages go; without any label all go.  Of languages that hold
    the same share of a text the one with more training text counts.
    """
    docs = docs.select(*COLUMNS)
    rows = language.identify(docs, docs, COLUMNS)
    return rows.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, with the lines that passed.

    Null, empty and wordless texts fail; of equal lines the first stays; repeated rows are judged alike.
    """
    # written first: a filter pushed down to the scan would repeat the measures' nested expressions
    rows = materialize(quality.measure(docs.select(*COLUMNS), ["doc_id", "lang", "source"]), "measured").where("kept")
    return rows.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Of rows with the same smallest id the first stays; null ids stay only where a class has no other; wordless texts are
    classes of their own.
    """
    staged = neardup.stage_rows(docs, COLUMNS)
    keepers = neardup.near_duplicates(staged).where("keeper").select("_row")
    return staged.join(keepers, "_row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has too.

    Rows with equal ids, or with null ids, take nothing from each other; texts below 50 bytes lose nothing; null texts become empty.
    """
    staged = neardup.stage_rows(docs, COLUMNS)
    kept = suffix_dedup.remove_repeats(staged, with_text=True).select("_row", "kept_text")
    rows = staged.select("_row", "doc_id", "lang", "source").join(kept, "_row")
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    Null and empty texts are one end id; ties on the curve are ordered by id and text.
    """
    import public_tokenizers as tokenizers

    return packing.pack(docs.select("doc_id", "text"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [
    ("language", language_id),
    ("quality", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", pack),
]
#: SQL has no form for most stages; a test holds all five against brute force, down to the packed ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's work tables go when its output is written, that output when the next one is."""
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = work_path(spark, "stage-" + name.replace(" ", "-"))
        with work_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        drop_paths(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
