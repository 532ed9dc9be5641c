"""Packing of token sequences: sum-of-squares placement into bins of a fixed length.

Texts are encoded, ended with one id and cut into pieces of at most ``capacity`` tokens; only
longer ones are cut. Pieces of full length are sequences of their own. The others are dealt by
hash to groups of bounded size. In a group each piece goes where the sum of squares of the
counts of open sequences per residual gap becomes smallest (a new sequence is one of the
choices; ties go to the smallest gap). That keeps every gap in stock, so that most sequences
end full. Each group is packed with its sizes mixed and with the longest first, and the
packing with fewer sequences counts. Sequences that stay open at the end of a group hand their pieces to the next round,
with fewer groups, until one group is left: what is lost is a few sequences in all, not a few
per group. Only (piece number, length) is shuffled for that.

Defined cases: a null text counts as empty and is one piece with the end id. Repeated rows and
rows without id are packed as rows of their own. Texts are packed whole, however long. An
empty table gives an empty result. Columns beside key and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.llm.common import append_columns, named
from tillview.llm.remembered import Remembered, library, words
from tillview.sources.scratch import materialize

CAPACITY = 4096
END = 1
#: Pieces that meet in one task, about.
GROUP = 16_384
#: A sequence with a smaller share of free places is left as it is between rounds.
FREE = 1 / 128
#: Sequence numbers: round, group and place in the group.
ROUND_BITS, GROUP_BITS, FULL_BIT = 56, 24, 62


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text", end: int = END) -> DataFrame:
    """``docs`` with ``ids``: the packed unsigned 32-bit ids of the whole text and the end id.

    ``vocabulary`` is the path of a tokenizer file on the driver whose tokens hold no white
    space; its content, bounded by the file, is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast({"content": file.read()})
    last = np.array([end], dtype="<u4").tobytes()

    def make(texts: pa.Array) -> list[pa.Array]:
        state = shared.value
        if "encoder" not in state:
            state["encoder"] = Remembered(library(state["content"]))
        ids = state["encoder"].ids([words(t or "") for t in texts.to_pylist()])
        return [pa.array([i + last for i in ids], pa.binary())]

    return append_columns(docs, [text], [T.StructField("ids", T.BinaryType())], make)


def cut(encoded: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(number, key, piece, start, length, ids): pieces of at most ``capacity`` tokens, each with a number of its own."""
    total = F.length("ids") / 4
    pieces = encoded.select(
        named(key).alias(key), "ids", F.explode(F.sequence(F.lit(0), (F.ceil(total / capacity) - 1).cast("int"))).alias("piece")
    )
    start = F.col("piece") * capacity
    part = F.substring("ids", start * 4 + 1, F.lit(capacity * 4))
    return pieces.select(
        F.monotonically_increasing_id().alias("number"),
        F.col(key),
        "piece",
        start.cast("bigint").alias("start"),
        (F.length(part) / 4).cast("bigint").alias("length"),
        part.alias("ids"),
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in this order: the sequence and the offset of each."""
    never = np.int64(1) << 60
    # by gap: change of the sum when an open sequence with it goes, when one with it comes
    leave = np.full(capacity + 1, never)
    leave[capacity] = 0  # a new sequence is no open one
    come = np.ones(capacity + 1, np.int64)
    come[0] = 0  # a full sequence is no open one
    open_: dict[int, list[int]] = {}
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0

    def recount(gap: int) -> None:
        n = len(open_[gap])
        leave[gap] = 1 - 2 * n if n else never
        come[gap] = 2 * n + 1

    for k, length in enumerate(lengths.tolist()):
        gap = int((leave[length:] + come[: capacity + 1 - length]).argmin()) + length
        if gap == capacity:
            chosen, made = made, made + 1
        else:
            chosen = open_[gap].pop()
            recount(gap)
        if gap > length:
            open_.setdefault(gap - length, []).append(chosen)
            recount(gap - length)
        place[k], offset[k] = chosen, capacity - gap
    return place, offset


def _round(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """(number, length, sequence_id, offset, free): one round of placements, group by group."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        # by hash, so that sizes come mixed, and the same in every run of a task; or long ones first
        frame = frame.sort_values(["mixed", "number"], ignore_index=True)
        lengths = frame["length"].to_numpy()
        falling = np.argsort(-lengths, kind="stable")
        place, offset = sum_of_squares(lengths, capacity)
        other = sum_of_squares(lengths[falling], capacity)
        if other[0].max() < place.max():
            place[falling], offset[falling] = other
        filled = np.bincount(place, frame["length"]).astype(np.int64)
        first = (turn << ROUND_BITS) + (int(frame["group"].iloc[0]) << GROUP_BITS)
        return pd.DataFrame(
            {
                "number": frame["number"],
                "length": frame["length"],
                "sequence_id": first + place,
                "offset": offset,
                "free": capacity - filled[place],
            }
        )

    dealt = pieces.select(
        "number",
        "length",
        F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(groups)).alias("group"),
        F.xxhash64("number", F.lit("order"), F.lit(turn)).alias("mixed"),
    )
    return dealt.groupBy("group").applyInPandas(
        pack, "number bigint, length bigint, sequence_id bigint, offset bigint, free bigint"
    )


def place(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(number, sequence_id, offset) for every row of ``pieces`` (number, length)."""
    full = pieces.where(F.col("length") == capacity).select(
        "number", (F.lit(1 << FULL_BIT).cast("bigint") + F.col("number")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    left = pieces.where(F.col("length") < capacity).select("number", "length")
    count, turn, done = left.count(), 0, [full]
    while count:
        groups = -(-count // group)
        packed = materialize(_round(left, groups, turn, capacity), "packed")
        again = (F.col("free") > int(capacity * FREE)) & F.lit(groups > 1)
        done.append(packed.where(~again).select("number", "sequence_id", "offset"))
        left, before = packed.where(again).select("number", "length"), count
        count, turn = left.count(), turn + 1
        if 2 * count > before:  # sizes that fill no sequence: another round would change little
            done.append(packed.where(again).select("number", "sequence_id", "offset"))
            break
    placed = done[0]
    for part in done[1:]:
        placed = placed.union(part)
    return placed


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the packed training sequences; each is bounded by the capacity."""
    parts = pieces.select("number", "length", "ids").join(placed, "number")
    packed = parts.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    # concat of binary keeps bytes
    joined = F.aggregate("parts", F.lit(b""), lambda all_, part: F.concat(all_, part["ids"]))
    return packed.select("sequence_id", joined.alias("ids"), "length")
