"""The checked queries of the operators, one for each, and their SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import (
    ball_tree,
    block_neighbours,
    conversation_repair,
    html_text,
    jaccard_join,
    language,
    packing,
    personal_data,
    piece_lattice,
    sharding,
    suffix_dedup,
    warc_archive,
    whitening,
)
from tablemill.llm.store import Workspace, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Register a query; with ``sql``, rows for another engine to compare."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what was cut, and with the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


_FINITE = """len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query(
    f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
               FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
)
def op2_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query(
    f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND {_FINITE}),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
)
def op9_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


@query()
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query()
def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are no group that has to stay together here: the law dealt is that of equal row counts."""
    placed = sharding.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    none = F.lit(None).cast("int").alias("grown_shard")
    size = sharding.size_of(F.col("text")).alias("size")
    return placed.select("doc_id", size, F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", none)


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{kind}" for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, with_ids=False)


@query()
def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four segmentations of every document, with their scores and the best one's ids."""
    return piece_lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4)


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by text and source, and every page by text, markup, address and host; one model, fitted on documents.

    A row has either a doc_id or a page_id.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = html_text.extract(table(spark, sf_dir, "pages"), language.markup_language(F.col("html").cast("string")).alias("declared"))
    pages = Workspace(spark, "pages").write(pages.select("page_id", "url", "declared", "text"))
    model = language.fit(docs, "lang")
    of_docs = language.identify(docs, declared=None, host="source", model=model, unknown="unknown")
    of_pages = language.identify(pages, declared="declared", address="url", model=model, unknown="unknown")
    both = of_docs.unionByName(of_pages, allowMissingColumns=True)
    return both.select("doc_id", "page_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", "accepted")


@query()
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the hash of its rows and repaired at least cost."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.plan(conversation_repair.damaged(turns), every=turns)


# base 32 of a hash of 40 hexadecimal digits: five of them are four letters
_BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(sha1(html), 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '')"""


@query(
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> best THEN best END AS refers_to
    FROM p
    """
)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    made = warc_archive.write(table(spark, sf_dir, "pages"))
    found = warc_archive.read(made, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=32)
