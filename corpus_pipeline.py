"""From raw documents to token ids: language, boilerplate lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; between stages the
rows are written to the shared folder and read again. All but the last return the columns
of their input. Stages take null columns, empty tables and further columns; rows without
an id can't be compared with others and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.llm import language, leaks, lines, minhash, tokens
from tillview.llm.common import named, table
from tillview.sources.scratch import materialize

VOCABULARY = "word_bpe_49k.json"
# Python stages can't be expressed in SQL; tests/llm compare the stages with brute force
ORACLE_SQL = None


def _free(docs: DataFrame, stem: str) -> str:
    """A name that no column has."""
    return next(n for n in (f"{stem}_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)


def _as_before(after: DataFrame, docs: DataFrame) -> DataFrame:
    return after.select(*map(named, docs.columns))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; learned from a bounded sample of the labelled ones."""
    dictionaries = language.learn(docs, F.lit(True))
    text = docs.select(*map(named, docs.columns), *(named(c).alias(f"{c}_") for c in _taken(docs)))
    judged = language.classify(text, dictionaries).where(~F.col("rejected"))
    return judged.select(*(named(f"{c}_").alias(c) if c in _taken(docs) else named(c) for c in docs.columns))


def _taken(docs: DataFrame) -> list[str]:
    """Columns of the documents that are named like a result of the classifier."""
    return [c for c in docs.columns if c in {f.name for f in language.FIELDS}]


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sites share; documents left without any text go."""
    clean = lines.drop_boilerplate(docs, counts=("lines_met_", "lines_removed_"))
    left = (F.trim(named("text")) != "") | (F.col("lines_removed_") == 0) | named("text").isNull()
    return _as_before(clean.where(left), docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates, once; other texts under its id stay."""
    mark, id_, hash_ = _free(docs, "mark"), _free(docs, "id"), _free(docs, "hash")
    stay = materialize(minhash.representatives(docs).toDF(id_, hash_), "stay")
    known = docs.where(named("doc_id").isNotNull()).withColumn(mark, F.xxhash64(named("text")))
    one = known.join(stay, (named("doc_id") == F.col(id_)) & (F.col(mark) == F.col(hash_)), "left_semi")
    return _as_before(one.dropDuplicates(["doc_id", mark]), docs).union(docs.where(named("doc_id").isNull()))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = leaks.find(docs, table(spark, sf_dir, "benchmark"))
    return leaks.drop_documents(docs, materialize(found.where(F.size("hits") > 0), "hits"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document: packed unsigned 32-bit integers, with what they decode to."""
    import public_tokenizers

    whole = tokens.encode_and_decode(spark, docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return whole.select("doc_id", "n_tokens", "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_language),
    ("lines", drop_boilerplate_lines),
    ("near_duplicates", keep_one_of_each_class),
    ("leaks", drop_leaks),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
