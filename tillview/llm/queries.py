"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.llm import (
    alignment,
    language,
    leaks,
    licenses,
    lines,
    minhash,
    negatives,
    packing,
    secrets,
    statements,
    tokens,
    urls,
    vectors,
    warc,
)
from tillview.llm.common import table
from tillview.sources.scratch import materialize


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    records = warc.round_trip(table(spark, sf_dir, "pages"), warc.shared_folder(spark, "warc"))
    return records.select(
        F.col("id").alias("page_id"), "url", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document's whole text."""
    return language.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document's whole text."""
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and what they decode to, as digests."""
    import public_tokenizers

    return tokens.with_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its cross-site boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.drop_boilerplate(docs, counts=("n_lines", "n_removed")).drop("source")


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's whole text shares with the benchmark."""
    return leaks.report(leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.learn(pages)).drop("url")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document's whole text names."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives, from all vectors."""
    label, moved = F.col("label").cast("bigint"), F.col("vec_id") % 7 == 0
    return negatives.mine(
        table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=F.when(moved, (label + 1) % 10).otherwise(label)
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document's whole text."""
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = materialize(alignment.align(spark, docs, *files).drop("text"), "aligned")
    return alignment.link_counts(aligned, "doc_id", alignment.sizes(*files))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces and the sequences they are packed into."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = packing.encode(spark, docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
    pieces = materialize(packing.cut(encoded), "pieces")
    digests = pieces.select("number", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(packing.place(pieces), "number").drop("number")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_vectors": op2_vectors,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_minhash": op5_minhash,
    "op6_bpe": op6_bpe,
    "op7_lines": op7_lines,
    "op8_leaks": op8_leaks,
    "op9_urls": op9_urls,
    "op10_licenses": op10_licenses,
    "op11_negatives": op11_negatives,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}
STATEMENTS: dict[str, str] = {
    "op1_warc": statements.WARC,
    "op2_vectors": statements.VECTORS,
    "op7_lines": statements.LINES,
    "op8_leaks": statements.LEAKS,
    "op10_licenses": licenses.statement(),
    "op11_negatives": statements.NEGATIVES,
}
