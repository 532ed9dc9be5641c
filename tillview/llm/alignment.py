"""Alignment of two tokenizers' tokens by pointer jumping.

A text is encoded by both tokenizers; the tokens of either tile the same bytes. Every token
points to the token that overlaps it and reaches farthest to the right, of both kinds (at equal
ends to the second tokenizer's). Successors are doubled, for all tokens of some MB of texts at
once, until nothing changes: every token then points to the terminal token of its component.
Terminal tokens number the groups, which are the shortest runs with ends in common.

Counts. Two tokens are linked in every group that holds both. A pair of ids counts once a
document. Pairs that stand in more than a fixed share of all (document, pair) rows are few by
that share; they are looked up in a broadcast table. Rows of rarer pairs are joined by pair, so
no key of that join has more rows than the share allows.

Defined cases: texts that are null or empty, or that one tokenizer does not give back byte by
byte, have no tokens. Strings of special tokens are plain text. Repeated rows and rows without
id are documents of their own. Texts are aligned whole, however long. An empty table gives an
empty result. Columns beside key and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tillview.llm.common import append_columns, named, slices
from tillview.llm.tokens import byte_symbols
from tillview.sources.scratch import materialize

#: A pair in more than 1 / FREQUENT of all (document, pair) rows is broadcast: fewer than FREQUENT pairs.
FREQUENT = 100_000
#: Links that are held one by one at a time, and links of one group above which equal ids are merged first.
LINKS_HELD = 1 << 17
LARGE_GROUP = 4096
#: Pairs of ids are smaller than 2 to this power: vocabularies of up to a million tokens each.
PAIR_BITS = 40
#: Bytes of texts, and 16-bit tokens of a, that a task works on at a time.
SLICE_BYTES, SLICE_TOKENS = 1 << 18, 1 << 16

#: The aligned text: packed ids of both tokenizers, and for each id a bit that is 1 at the end of its group.
FIELDS = [T.StructField(n, T.BinaryType()) for n in ("a_ids", "b_ids", "a_last", "b_last")]


# fixed values: the splitter of the byte-level vocabulary
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_SIGN = "▁"
#: Unicode tables of two libraries agree on the letters and numbers up to here.
_BEYOND = re.compile(r"[^\x00-\xff]")


class Pair:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, byte_level: str, pieces: bytes):
        spec = json.loads(byte_level)
        vocab = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        plain = {t: i for t, i in vocab.items() if all(c in byte_of for c in t)}
        for token, i in plain.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.library = Tokenizer.from_str(byte_level)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        made = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in spec["model"]["merges"]]
        # ranks stand for the merges if tokens are numbered in their order
        self.ranked = None
        if made == sorted(made):
            ranks = {self.a_bytes[i]: i for i in [*(i for i in plain.values() if len(self.a_bytes[i]) == 1), *made]}
            self.ranked = tiktoken.Encoding("ranked", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode()
            for i, p in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        ]
        self.a_long = np.array([len(t) for t in self.a_bytes])
        self.b_long = np.array([len(t) for t in self.b_bytes])

    def first(self, text: str) -> list[int]:
        if self.ranked is None or _BEYOND.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none where one does not give the bytes of space + text."""
        a = [self.first(" " + t) if t else [] for t in texts]
        b = self.model.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            wanted = (" " + text).encode()
            if not (wanted == _joined(self.a_bytes, a[i]) == _joined(self.b_bytes, b[i])):
                a[i] = b[i] = []
        return a, b


def _joined(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For tokens that tile the same bytes, by their ends: the terminal token of each one's component.

    Tokens are numbered a first, then b; a terminal is always a token of b.
    """
    a, b = len(a_ends), len(b_ends)
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    # the last token that begins before the end reaches at least as far
    to_b = np.searchsorted(b_starts, a_ends, "left") - 1 + a
    to_a = np.searchsorted(a_starts, b_ends, "left") - 1
    farther = a_ends[to_a] > b_ends
    successor = np.r_[to_b, np.where(farther, to_a, np.arange(a, a + b))]
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor
        successor = doubled


def group_sizes(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a and tokens of b in each group, in order."""
    if not len(a_ends):
        return (np.empty(0, np.int64),) * 2
    label = terminals(a_ends, b_ends)
    a = len(a_ends)
    last = np.flatnonzero(label[a:] == np.arange(a, len(label)))
    rank = np.zeros(len(b_ends), np.int64)
    rank[last] = np.arange(len(last))
    group = rank[label - a]
    return np.bincount(group[:a], minlength=len(last)), np.bincount(group[a:], minlength=len(last))


def id_type(size: int) -> str:
    """How ids of a vocabulary of this size are packed: unsigned little-endian integers of 16 or 32 bits."""
    return "<u2" if size <= 1 << 16 else "<u4"


def align(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """``docs`` with ``a_ids``, ``b_ids`` and the ends of their groups, ``a_last`` and ``b_last``.

    ``byte_level`` and ``pieces`` are the paths of both tokenizer files on the driver; their
    contents, bounded by the files, are broadcast.
    """
    with open(byte_level, encoding="utf-8") as first, open(pieces, "rb") as second:
        shared = spark.sparkContext.broadcast({"files": (first.read(), second.read())})

    def make(texts: pa.Array) -> list[pa.Array]:
        state = shared.value
        if "pair" not in state:
            state["pair"] = Pair(*state["files"])
        pair = state["pair"]
        a, b = pair.encode([t or "" for t in texts.to_pylist()])
        a_ids, b_ids = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        # a text's last tokens end together, so no group belongs to two texts
        a_counts, b_counts = group_sizes(np.cumsum(pair.a_long[a_ids]), np.cumsum(pair.b_long[b_ids]))
        a_many, b_many = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        return [
            _rows_of(a_many, a_ids.astype(id_type(len(pair.a_bytes)))),
            _rows_of(b_many, b_ids.astype(id_type(len(pair.b_bytes)))),
            _bits_of(a_many, np.cumsum(a_counts) - 1),
            _bits_of(b_many, np.cumsum(b_counts) - 1),
        ]

    return append_columns(docs, [text], FIELDS, make, SLICE_BYTES)


def _rows_of(many: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary value for each row, which has so ``many`` of the values."""
    offsets = pa.py_buffer((np.r_[0, np.cumsum(many)] * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(many), [None, offsets, pa.py_buffer(values)])


def _bit_places(many: np.ndarray) -> np.ndarray:
    """Where the bit of each value lies if every row's bits begin with a byte."""
    held = -(-many // 8) * 8
    return np.arange(many.sum()) + np.repeat(np.cumsum(held) - held - (np.cumsum(many) - many), many)


def _bits_of(many: np.ndarray, ones: np.ndarray) -> pa.Array:
    """A binary value for each row with a bit for each of its values; ``ones`` are the values with a 1."""
    held = -(-many // 8)
    bits = np.zeros(held.sum() * 8, np.uint8)
    bits[_bit_places(many)[ones]] = 1
    return _rows_of(held, np.packbits(bits, bitorder="little"))


def _ones(column: pa.Array, many: np.ndarray) -> np.ndarray:
    """The values with a 1 of a column of :func:`_bits_of`."""
    bits = np.unpackbits(_flat(column, "u1")[0].astype(np.uint8), bitorder="little")
    return np.flatnonzero(bits[_bit_places(many)])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    values = data.view(kind)
    return values.astype(np.int64), np.diff(offsets) // values.itemsize


class Aligned:
    """Aligned texts of some rows as flat arrays."""

    def __init__(self, columns: list[pa.Array], sizes: tuple[int, int]):
        self.rows = len(columns[0])
        (self.a, a_many), (self.b, b_many) = (_flat(c, id_type(n)) for c, n in zip(columns, sizes))
        a_last, b_last = _ones(columns[2], a_many), _ones(columns[3], b_many)
        self.na, self.nb = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        self.a_rows, self.b_rows = (np.repeat(np.arange(self.rows), many) for many in (a_many, b_many))
        self.group_rows = self.a_rows[a_last]

    def links(self, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, links) of the different pairs of each row; a pair is a id x ``b_size`` + b id."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        product = self.na * self.nb
        a_first, b_first = np.cumsum(self.na) - self.na, np.cumsum(self.nb) - self.nb
        small = np.flatnonzero(product <= LARGE_GROUP)
        until, start = np.cumsum(product[small]), 0
        while start < len(small):
            held = until[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(until, held + LINKS_HELD, "right")))
            some = small[start:end]
            of = np.repeat(np.arange(len(some)), product[some])
            inside = np.arange(len(of)) - np.repeat(np.cumsum(product[some]) - product[some], product[some])
            g = some[of]
            left, right = self.a[a_first[g] + inside // self.nb[g]], self.b[b_first[g] + inside % self.nb[g]]
            found.append(_counted(self.group_rows[g], left * b_size + right))
            start = end
        for g in np.flatnonzero(product > LARGE_GROUP):
            a, a_times = np.unique(self.a[a_first[g] : a_first[g] + self.na[g]], return_counts=True)
            b, b_times = np.unique(self.b[b_first[g] : b_first[g] + self.nb[g]], return_counts=True)
            pairs = (a[:, None] * b_size + b).ravel()
            found.append((np.full(len(pairs), self.group_rows[g]), pairs, np.outer(a_times, b_times).ravel()))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return found[0] if len(found) == 1 else _counted(*map(np.concatenate, zip(*found)))

    def digests(self) -> list[str]:
        """Per row the SHA-256 of its groups ``a1,a2|b1;...``, empty without tokens."""
        a_group, b_group = np.repeat(np.arange(len(self.na)), self.na), np.repeat(np.arange(len(self.nb)), self.nb)
        at_a = (np.cumsum(self.nb) - self.nb)[a_group] + np.arange(len(self.a))
        at_b = np.cumsum(self.na)[b_group] + np.arange(len(self.b))
        ids, signs = np.empty(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        # an id is followed by a comma, the last of a group's side by another sign
        signs[at_a[np.cumsum(self.na) - 1]], signs[at_b[np.cumsum(self.nb) - 1]] = 1, 2
        size = int(ids.max(initial=0)) + 1
        many = np.bincount(self.a_rows, minlength=self.rows) + np.bincount(self.b_rows, minlength=self.rows)
        shown, until, out = _shown(size), np.r_[0, np.cumsum(many)], []
        places = (signs * (len(shown) // 3) + ids).tolist()
        for begin, end in zip(until.tolist(), until[1:].tolist()):
            joined = "".join(map(shown.__getitem__, places[begin:end]))[:-1]
            out.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
        return out


@lru_cache(maxsize=1)
def _ids_shown(size: int) -> list[str]:
    return [f"{i}{sign}" for sign in ",|;" for i in range(size)]


def _shown(size: int) -> list[str]:
    """The ids below a power of two as text with each of the three signs."""
    return _ids_shown(1 << (size - 1).bit_length())


def _counted(rows: np.ndarray, pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (row, pair), in order, with their links added up; one each without ``times``."""
    joint = rows << PAIR_BITS | pairs
    if times is None:
        joint, times = np.unique(joint, return_counts=True)
    else:
        joint, at = np.unique(joint, return_inverse=True)
        times, links = np.zeros(len(joint), np.int64), times
        np.add.at(times, at, links)
    return joint >> PAIR_BITS, joint & ((1 << PAIR_BITS) - 1), times


def pair_counts(aligned: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(pair, documents, best): in how many rows each linked pair stands, and whether that is its a id's highest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(slices(batch, [0], 2 * SLICE_TOKENS) for batch in batches):
            pairs, documents = np.unique(Aligned(part.columns, sizes).links(sizes[1])[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(documents)], names=["pair", "documents"])

    parts = aligned.select(*(f.name for f in FIELDS)).mapInArrow(count, "pair bigint, documents bigint")
    counts = materialize(parts.groupBy("pair").agg(F.sum("documents").alias("documents")), "pairs")
    a_id = F.floor(F.col("pair") / sizes[1])
    # at most one row for each token of the first vocabulary
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("documents").alias("highest"))
    flagged = counts.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id")
    return materialize(flagged.select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best")), "counts")


def link_counts(aligned: DataFrame, key: str, sizes: tuple[int, int], frequent: int = FREQUENT) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``aligned``.

    ``aligned`` must be a stored table: it is read twice. ``sizes`` is how many ids both files have.
    """
    counts = pair_counts(aligned, sizes)
    total = counts.agg(F.sum("documents")).first()[0] or 0
    common = counts.where(F.col("documents") * frequent > total)  # fewer than ``frequent`` rows
    known = common.orderBy("pair").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast(
        {n: known.column(n).to_numpy() for n in ("pair", "documents", "best")}
    )
    key_type = aligned.schema[key].dataType.simpleString()
    plain = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = f"key {key_type}, {', '.join(f'{n} bigint' for n in plain)}, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, documents, best = (shared.value[n] for n in ("pair", "documents", "best"))
        for part in chain.from_iterable(slices(batch, [0], 2 * SLICE_TOKENS) for batch in batches):
            some = Aligned(part.columns[:4], sizes)
            rows, met, times = some.links(sizes[1])
            at = np.minimum(np.searchsorted(pairs, met), max(len(pairs) - 1, 0))
            hit = pairs[at] == met if len(pairs) else np.zeros(len(met), bool)
            total, highest = np.zeros(some.rows, np.int64), np.zeros(some.rows, np.int64)
            np.add.at(total, rows[hit], times[hit] * documents[at[hit]])
            np.add.at(highest, rows[hit], times[hit] * best[at[hit]])
            groups = np.bincount(some.group_rows, minlength=some.rows)
            links = np.zeros(some.rows, np.int64)
            np.add.at(links, some.group_rows, some.na * some.nb)
            rest = ~hit
            until = pa.array(np.r_[0, np.cumsum(np.bincount(rows[rest], minlength=some.rows))], pa.int32())
            columns = [np.bincount(some.a_rows, minlength=some.rows), np.bincount(some.b_rows, minlength=some.rows)]
            columns += [groups, links, highest, total]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(4),
                    *(pa.array(c, pa.int64()) for c in columns),
                    pa.array(some.digests(), pa.string()),
                    pa.ListArray.from_arrays(until, pa.array(met[rest], pa.int64())),
                    pa.ListArray.from_arrays(until, pa.array(times[rest], pa.int64())),
                ],
                names=["key", *plain, "groups_sha256", "pairs", "times"],
            )

    looked = aligned.select(*(f.name for f in FIELDS), named(key).alias("key")).mapInArrow(look_up, schema)
    looked = materialize(looked.withColumn("row", F.monotonically_increasing_id()), "looked")
    rare = looked.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    found = rare.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")).join(
        counts.where(F.col("documents") * frequent <= total), "pair"
    )
    added = found.groupBy("row").agg(
        F.sum(F.col("times") * F.col("documents")).alias("more"), F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best")
    )
    whole = looked.drop("pairs", "times").join(added, "row", "left")
    return whole.select(
        F.col("key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def sizes(byte_level: str, pieces: str) -> tuple[int, int]:
    """How many ids each of the two tokenizer files has."""
    with open(byte_level, encoding="utf-8") as first, open(pieces, "rb") as second:
        pair = Pair(first.read(), second.read())
    return len(pair.a_bytes), len(pair.b_bytes)
