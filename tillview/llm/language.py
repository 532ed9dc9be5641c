"""Language by compression: the language whose sample packs a text smallest.

Each language gets a raw-content dictionary made of text in that language. A text is
reduced to lower-case letters and single spaces, cut into pieces, and every piece is
packed with every dictionary; the language with the smallest sum wins. Pieces keep a
repetitive text from packing itself, so the dictionary decides, and all pieces of the
whole text count. Sums that tie (very short texts) are decided by what the text adds
behind a passage of the language. The margin is the share saved against the second
best; a narrow margin is a rejection.

Defined cases: a null text, an empty one or one without letters is ``und`` with
score 0 and rejected; so is every text if nothing was learned. Complete ties go to
the language first by name and are rejected. Rows whose key or language is null are
not learned from, but predicted. Repeated rows get equal results. Columns named like
a result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.llm.common import append_columns, bounded_sample, named

UNDETERMINED = "und"
#: Documents per language to learn from, at most; the bound of the sample.
SAMPLE_DOCUMENTS = 128
#: Languages to learn, at most: those of most labelled documents, the first by name of equals.
SAMPLE_LANGUAGES = 256
#: Characters of the passage that one document adds, from a place that a hash picks in the whole text.
SAMPLE_CHARS = 1024
PIECE_BYTES = 2_000
PASSAGE_BYTES = 1_500
LEVEL = 6
#: A margin below this share is too narrow.
NARROW = 0.01
FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters with one space around each word; empty if there is no letter."""
    kept = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not kept or not any(c.isalpha() for c in kept):
        return b""
    return f" {kept} ".encode("utf-8", "ignore")


class Packers:
    """A compressor per language, made from plain bytes."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.packers = {}
        for name, content in sorted(dictionaries.items()):
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL,
                source_size=PIECE_BYTES,
                dict_size=len(content),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=settings)
            packer = zstandard.ZstdCompressor(compression_params=settings, dict_data=shared)
            passage = content[:PASSAGE_BYTES]
            self.packers[name] = (packer.compress, passage, len(packer.compress(passage)))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language and the margin by which it wins."""
        content = letters(text or "")
        if not content or not self.packers:
            return UNDETERMINED, 0.0
        pieces = [content[i : i + PIECE_BYTES] for i in range(0, len(content), PIECE_BYTES)]
        sizes = sorted((sum(len(pack(p)) for p in pieces), name) for name, (pack, _, _) in self.packers.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        if sizes[0][0] == sizes[1][0]:
            level = {name for size, name in sizes if size == sizes[0][0]}
            sizes = sorted(
                (sum(len(pack(passage + p)) - alone for p in pieces), name)
                for name, (pack, passage, alone) in self.packers.items()
                if name in level
            )
        (best, name), (second, _) = sizes[:2]
        return name, max(0.0, (second - best) / max(second, 1))


def learn(docs: DataFrame, learned: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries from a bounded sample of the labelled rows where ``learned`` holds.

    At most SAMPLE_DOCUMENTS documents of each of at most SAMPLE_LANGUAGES languages give a
    passage of SAMPLE_CHARS characters each; that bound also holds for what reaches the driver.
    """
    labelled = docs.where(learned & named(text).isNotNull())
    found = labelled.where(named(lang).isNotNull()).groupBy(named(lang).alias(lang)).count()
    most = found.orderBy(F.desc("count"), named(lang)).limit(SAMPLE_LANGUAGES).select(lang)
    narrow = labelled.select(key, lang).join(F.broadcast(most), lang, "left_semi")
    chosen = bounded_sample(narrow, key, lang, SAMPLE_DOCUMENTS)
    places = F.greatest(F.char_length(named(text)) - SAMPLE_CHARS + 1, F.lit(1))
    start = F.pmod(F.xxhash64(named(key), F.lit("passage")), places.cast("bigint")) + 1
    rows = (
        labelled.select(key, lang, F.substring(named(text), start.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece"))
        .join(F.broadcast(chosen), [key, lang])
        .groupBy(key, lang)
        .agg(F.min("piece").alias("piece"))
        .collect()
    )
    by_language: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
    for row in rows:
        by_language[row[lang]].append((row[key], letters(row["piece"])))
    joined = {name: b"".join(piece for _, piece in sorted(found)) for name, found in by_language.items()}
    return {name: content for name, content in joined.items() if content}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast({"dictionaries": dictionaries})

    def make(texts: pa.Array) -> list[pa.Array]:
        state = shared.value
        if "packers" not in state:
            state["packers"] = Packers(state["dictionaries"])
        judged = [state["packers"].judge(t) for t in texts.to_pylist()]
        return [
            pa.array([name for name, _ in judged], pa.string()),
            pa.array([margin for _, margin in judged], pa.float64()),
            pa.array([name == UNDETERMINED or margin < NARROW for name, margin in judged], pa.bool_()),
        ]

    return append_columns(docs, [text], FIELDS, make)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 3."""
    return F.crc32(named(key).cast("string").cast("binary")) % 3


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Key, ``held_out`` and prediction of every row, learned from the rows that are not held out."""
    held_out = F.coalesce(fold(key) == 1, F.lit(False))
    model = learn(docs, ~held_out, key, text, lang)
    judged = classify(docs.select(key, text), model, text)
    return judged.select(key, held_out.alias("held_out"), "lang_pred", "score", "rejected")
