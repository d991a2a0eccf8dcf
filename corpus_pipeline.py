"""From raw documents to packed training sequences, in five stages.

Each stage takes the table its predecessor wrote and works on all of it. All but the last return the columns
of documents; where a text changes, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import jaccard_join, language, packing, personal_data, suffix_dedup
from tablemill.llm.store import Workspace, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go; ``lang`` becomes the language found, by which sequences are packed.

    Texts in a language that no row is labelled with stay, as ``unknown``.
    """
    found = language.identify(docs, declared=None, unknown="unknown").where("accepted")
    return found.select(*[F.col("language").alias(c) if c == "lang" else c for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


#: Bytes of a passage that is cut where it repeats: fifty words and more have some 200 at least.
PASSAGE_BYTES = 200


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again anywhere are cut out; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, spread=160).where("n_removed = 0 or n_removed < n_bytes")
    return _counted(cut.select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return _counted(personal_data.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences, each of one language."""
    return packing.pack(docs, with_ids=False, by="lang")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Neither n-best hashing nor packing has a form in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
