"""Benchmark decontamination: windows of benchmark words found in documents.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A window is
WINDOW consecutive words of an item, or the whole of a shorter one. The distinct
windows form a hash table that is broadcast if its measured size is within
BROADCAST_WINDOWS and BROADCAST_BYTES, and else joined by shuffle. Every position of
every document looks its window up by hash, and a hit is verified word by word. With a
broadcast it is one pass over the texts, and only hits, and one row per document, leave it.
By shuffle a position sends its own words and nothing else of its text, so the rows grow
in proportion to the text.

Defined cases: a null or empty text has no words and no hits. An item without words has
no window; one without an id hits but is not listed. Repeated documents each get their
row; items with equal ids are one. An empty benchmark hits nothing. Other columns play no
part; ``drop_documents`` and ``drop_spans`` keep them all.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.llm.common import named
from tillview.sources.scratch import materialize

WINDOW = 10
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_table(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(hash, window, length, items): every distinct window and the items that have it."""
    split = items.select(named(key).alias("item"), words(named(text)).alias("w")).where(F.size("w") > 0)
    long = F.least(F.size("w"), F.lit(size))
    each = split.select("item", "w", long.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - long + 1)).alias("at"))
    cut = each.select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("window"))
    grouped = cut.groupBy("window", "length").agg(F.collect_set("item").alias("items"))
    return grouped.select(F.xxhash64("window").alias("hash"), "window", "length", "items")


def find(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
) -> DataFrame:
    """(doc, text_hash, n_rows, n_words, hits, items) for each different document.

    ``hits`` are the places of the words hit, ``items`` the sorted ids as text; n_rows
    counts repeated rows.
    """
    windows = materialize(window_table(items, item_key, item_text, size), "windows")
    bound = windows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "window")) + 16 * F.size("window") + 16 * F.size("items")), F.lit(0)).alias("b"),
        F.collect_set("length").alias("lengths"),
    ).first()
    lengths = sorted(bound["lengths"], reverse=True) or [size]
    small = bound["n"] <= BROADCAST_WINDOWS and bound["b"] <= BROADCAST_BYTES
    read = docs.select(named(key).alias("doc"), F.xxhash64(named(text)).alias("text_hash"), words(named(text)).alias("w"))
    at = read.select("doc", "text_hash", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)))).alias("at"))
    if len(lengths) == 1:
        at = at.withColumn("long", F.lit(lengths[0]))
    else:
        at = at.withColumn("long", F.explode(F.array(*map(F.lit, lengths))))
    here = F.slice("w", F.col("at") + 1, F.col("long"))
    fits = F.col("at") + F.col("long") <= F.size("w")
    kept = _by_broadcast(at, F.broadcast(windows), here, fits, lengths[0]) if small else _by_shuffle(read, at, windows, here, fits)
    return (
        kept.groupBy("doc", "text_hash")
        .agg(
            F.count("n_words").alias("n_rows"),
            F.max("n_words").cast("bigint").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def _places() -> Column:
    return F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)


def _by_broadcast(at: DataFrame, windows: DataFrame, here: Column, fits: Column, longest: int) -> DataFrame:
    """(doc, text_hash, n_words, places, items): hits, and the first position of each document with its n_words."""
    probe = F.when(fits, F.xxhash64(here))
    joined = at.join(
        windows, (probe == windows["hash"]) & (F.col("long") == windows["length"]) & (here == windows["window"]), "left"
    )
    first = (F.col("at") == 0) & (F.col("long") == longest)
    return joined.where(first | F.col("length").isNotNull()).select(
        "doc",
        "text_hash",
        F.when(first, F.size("w")).alias("n_words"),
        F.when(F.col("length").isNotNull(), _places()).alias("places"),
        F.col("items").cast("array<string>").alias("items"),
    )


def _by_shuffle(read: DataFrame, at: DataFrame, windows: DataFrame, here: Column, fits: Column) -> DataFrame:
    """The same rows; a position meets the windows of its hash with no more than its own words."""
    own = at.where(fits).select("doc", "text_hash", "at", "long", here.alias("here")).withColumn("probe", F.xxhash64("here"))
    met = own.join(
        windows,
        (F.col("probe") == windows["hash"]) & (F.col("long") == windows["length"]) & (F.col("here") == windows["window"]),
    )
    none = F.lit(None)
    hits = met.select("doc", "text_hash", none.cast("int").alias("n_words"), _places().alias("places"), F.col("items").cast("array<string>"))
    counts = read.select(
        "doc", "text_hash", F.size("w").alias("n_words"), none.cast("array<int>").alias("places"), none.cast("array<string>").alias("items")
    )
    return hits.union(counts)


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document of the table that ``find`` read."""
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    return each.select(
        F.col("doc").alias(key),
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _free(df: DataFrame, stem: str) -> str:
    return next(n for n in (f"{stem}_{i}" for i in range(len(df.columns) + 1)) if n not in set(df.columns))


def _matched(docs: DataFrame, found: DataFrame, key: str, text: str, how: str) -> tuple[DataFrame, str]:
    doc, hash_, hits = _free(docs, "doc"), _free(docs, "hash"), _free(docs, "hits")
    hit = found.where(F.size("hits") > 0).select(
        F.col("doc").alias(doc), F.col("text_hash").alias(hash_), F.col("hits").alias(hits)
    )
    return docs.join(hit, named(key).eqNullSafe(F.col(doc)) & (F.xxhash64(named(text)) == F.col(hash_)), how), hits


def drop_documents(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that were hit."""
    return _matched(docs, found, key, text, "left_anti")[0]


def drop_spans(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every word that was hit cut out, and what stands behind it up to the next word."""
    joined, hits = _matched(docs, found, key, text, "left")
    pieces = F.regexp_extract_all(named(text), F.lit(CASED_WORD + NO_WORD), F.lit(0))
    left = F.filter(pieces, lambda _, i: ~F.array_contains(F.col(hits), i))
    cut = F.concat(F.regexp_extract(named(text), "^" + NO_WORD, 0), F.array_join(left, ""))
    clean = F.when(F.col(hits).isNull(), named(text)).otherwise(cut)
    return joined.select(*(clean.alias(c) if c == text else named(c) for c in docs.columns))
