"""Hard negatives by exact integer scores from subset-sum tables (Four Russians).

Components become integers. A candidate's integers are cut into bit planes in two's complement,
and a plane's bits of eight dimensions are packed into one byte. For every group of eight
dimensions an anchor has a table of the sums of all 256 subsets of its components. The sum of
the tables' entries at a plane's bytes is that plane's inner product; planes are shifted and
added from the highest, whose sign is negative, to the lowest. That gives the full exact score.

Anchors are a stated set of rows; they meet all rows in blocks of bounded size, dealt by hash.
A block gives each anchor its best rows only, so what is gathered per anchor is bounded by the
number of blocks. First the anchors meet rows of their own label, which gives the positives;
then all rows of other labels, which gives the negatives within each positive's band.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no
part. Of rows that share an id the one with the smallest label, then integers, counts. Vectors of different length do not meet; empty ones score 0.
Integers beyond 64 bits are held to that range and sums run modulo 2^64. Anchors without a
positive, and positives without a negative in their band, give no row. An empty table gives an
empty result. Columns beside id, vector and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.llm.common import named
from tillview.sources.scratch import materialize

POSITIVES = 5
NEGATIVES = 10
#: Share of the positive's score that a negative's score may have: from and to, in hundredths.
LEAST, MOST = 30, 90
SCALE = 256
#: Rows in a block, anchors in a set; a set meets a block in one step.
BLOCK_ROWS = 4096
ANCHORS = 128
#: Scores that are added up at a time: rows x anchors.
SCORES_HELD = 64 << 10


def integers(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, q): the rows that take part, with whole components."""
    wide = F.transform(named(vector), lambda x: x.cast("double"))
    rows = vectors.select(named(key).cast("bigint").alias("id"), label.alias("label"), wide.alias("v"))
    usable = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("bigint"))
    one = rows.where(usable).groupBy("id").agg(F.min(F.struct("label", whole.alias("q"))).alias("row"))
    return one.select("id", "row.label", "row.q")


def tables(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sums of all subsets of each group of eight components."""
    n, width = anchors.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.int64)
    padded[:, :width] = anchors
    parts = padded.reshape(n, -1, 8).transpose(1, 2, 0)
    sums = np.zeros((parts.shape[0], 256, n), np.int64)
    for bit in range(8):
        # subsets with this bit are those without it, plus the component
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + parts[:, bit, None]
    return sums


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """(planes, rows, groups) bytes of the integers in two's complement, the sign's plane first."""
    n, width = rows.shape
    most = int(np.maximum(rows, ~rows).max(initial=0))
    bits = most.bit_length() + 1
    padded = np.zeros((n, -(-width // 8) * 8), np.int64)
    padded[:, :width] = rows
    return np.stack(
        [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits - 1, -1, -1)]
    )


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products, a few rows at a time."""
    rows, anchors = planes.shape[1], sums.shape[2]
    out = np.empty((rows, anchors), np.int64)
    step = max(1, SCORES_HELD // max(1, anchors))
    for start in range(0, rows, step):
        part = planes[:, start : start + step]
        total = np.zeros((part.shape[1], anchors), np.int64)
        for place, plane in enumerate(part):
            np.left_shift(total, 1, out=total)
            for group in range(part.shape[2]):
                found = sums[group][plane[:, group]]
                # the sign's plane counts negative
                total = np.subtract(total, found, out=total) if place == 0 else np.add(total, found, out=total)
        out[start : start + step] = total
    return out


def _matrix(content: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(content, "<i8").reshape(rows, -1)


def _planes(content: bytes, rows: int, width: int) -> np.ndarray:
    groups = -(-width // 8)
    return np.frombuffer(content, np.uint8).reshape(-1, rows, groups) if groups else np.zeros((1, rows, 0), np.uint8)


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each value of ``by``: ids, labels and bit planes of its rows, in order of id."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        planes = bit_planes(np.stack(frame["q"].to_list()))
        one = {c: [frame[c].iloc[0]] for c in by}
        one |= {"ids": [frame["id"].to_numpy("<i8").tobytes()], "labels": [frame["label_no"].to_numpy("<i8").tobytes()]}
        return pd.DataFrame(one | {"planes": [planes.tobytes()]})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    used = dict.fromkeys([*by, "id", "label_no", "q"])
    return rows.select(*used).groupBy(*by).applyInPandas(pack, f"{kinds}, ids binary, labels binary, planes binary")


def _sets(anchors: DataFrame, by: list[str]) -> DataFrame:
    """One row for each value of ``by``: ids, labels and integers of its anchors, and what they are to meet.

    ``others`` and ``wanted`` are the positives and their scores, an anchor's from one of the
    ``places`` to the next.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        one = {c: [frame[c].iloc[0]] for c in by}
        lists = {n: [np.asarray(x, "<i8") for x in frame[n]] for n in ("others", "wanted")}
        flat = {
            "anchor_ids": frame["id"].to_numpy("<i8"),
            "anchor_labels": frame["label_no"].to_numpy("<i8"),
            "anchors": np.stack(frame["q"].to_list()).astype("<i8"),
            "places": np.cumsum([0, *map(len, lists["others"])]).astype("<i8"),
            **{n: np.concatenate(x) for n, x in lists.items()},
        }
        return pd.DataFrame(one | {n: [x.tobytes()] for n, x in flat.items()})

    kinds = ", ".join(f"{c} {anchors.schema[c].dataType.simpleString()}" for c in by)
    made = ", ".join(f"{n} binary" for n in ("anchor_ids", "anchor_labels", "anchors", "places", "others", "wanted"))
    used = dict.fromkeys([*by, "id", "label_no", "q", "others", "wanted"])
    return anchors.select(*used).groupBy(*by).applyInPandas(pack, f"{kinds}, {made}")


def _meet(sets: DataFrame, blocks: DataFrame, key: list[str], tasks: int) -> DataFrame:
    """Each set of anchors beside each block of the same key."""
    # a fixed number of partitions: the rows are few and heavy, their bytes say little of the work
    return sets.repartition(tasks, *key).join(blocks.repartition(tasks, *key), key)


def _cell(cells: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), cells)


def _each(cells: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), cells - 1))


class Met:
    """A set of anchors and a block of rows, with all their scores."""

    def __init__(self, row: dict):
        self.ids, self.labels, self.own, self.own_labels, self.places, self.others, self.wanted = (
            np.frombuffer(row[n], "<i8")
            for n in ("ids", "labels", "anchor_ids", "anchor_labels", "places", "others", "wanted")
        )
        planes = _planes(row["planes"], len(self.ids), row["width"])
        self.scores = scores(tables(_matrix(row["anchors"], len(self.own))), planes)

    def falling(self, anchor: int, use: np.ndarray) -> np.ndarray:
        """Places of the used rows by falling score; ids rise in a block, so ties keep the smaller first."""
        use = np.flatnonzero(use)
        return use[np.argsort(-self.scores[use, anchor], kind="stable")]


MET = ["width", "ids", "labels", "planes", "anchor_ids", "anchor_labels", "anchors", "places", "others", "wanted"]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[Met]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Met(batch.slice(k, 1).to_pylist()[0])


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The first rows of each group by falling score, then id; partial ranks come before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _positives(anchors: DataFrame, rows: DataFrame, tasks: int, count: int) -> DataFrame:
    """(anchor, positive, positive_score): the best other rows of the anchor's own label."""
    own = ["label_no", "width"]
    cells = rows.groupBy(*own).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("cells"))
    sets = anchors.groupBy(*own).agg(F.ceil(F.count("*") / ANCHORS).alias("sets"))
    blocks = _blocks(rows.join(cells, own).withColumn("cell", _cell(F.col("cells"), "cell")), [*own, "cell"])
    nothing = F.array().cast("array<bigint>")
    placed = anchors.join(sets, own).join(cells, own).withColumn("set", _cell(F.col("sets"), "set"))
    packed = _sets(placed.withColumns({"others": nothing, "wanted": nothing}), [*own, "cells", "set"])
    met = _meet(packed.withColumn("cell", _each(F.col("cells"))), blocks, [*own, "cell"], tasks)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _met(batches):
            found = []
            for i, anchor in enumerate(some.own):
                first = some.falling(i, some.ids != anchor)[:count]
                found.append(np.stack([np.full(len(first), anchor), some.ids[first], some.scores[first, i]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, 1)], names=["anchor", "id", "score"])

    found = met.select(*MET).mapInArrow(best, "anchor bigint, id bigint, score bigint")
    return _first(found, ["anchor"], count).select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))


def mine(
    vectors: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says of an ``id`` (BIGINT) whether its row is an anchor, ``label`` gives the label of
    a row (the column ``label`` if left out). A negative's score is at least ``least`` and at most
    ``most`` hundredths of the positive's.
    """
    whole = materialize(integers(vectors, key, vector, named("label") if label is None else label), "integers")
    numbers = materialize(whole.select("label").distinct().withColumn("label_no", F.monotonically_increasing_id()), "labels")
    rows = materialize(whole.join(numbers, "label").select("id", "label_no", F.size("q").alias("width"), "q"), "rows")
    anchors = materialize(rows.where(anchor), "anchors")
    cells = max(1, -(-rows.count() // BLOCK_ROWS))
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, cells)
    pairs = materialize(_positives(anchors, rows, tasks, positives), "positives")

    # every set of anchors meets every block: a stated set against all rows
    band = F.collect_list(F.struct("positive", "positive_score"))
    bands = pairs.groupBy(F.col("anchor").alias("id")).agg(band.alias("bands"))
    known = anchors.join(bands, "id").withColumns({"others": F.col("bands.positive"), "wanted": F.col("bands.positive_score")})
    sets = _sets(known.withColumn("set", _cell(F.lit(max(1, -(-anchors.count() // ANCHORS))), "set")), ["width", "set"])
    blocks = _blocks(rows.withColumn("cell", _cell(F.lit(cells).cast("bigint"), "cell")), ["width", "cell"])
    met = _meet(sets.withColumn("cell", _each(F.lit(cells).cast("bigint"))), blocks, ["width", "cell"], tasks)
    columns = ["anchor", "positive", "positive_score", "id", "score"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _met(batches):
            found = []
            for i, own in enumerate(some.own):
                order = some.falling(i, some.labels != some.own_labels[i])
                ranked = -some.scores[order, i]
                for k in range(some.places[i], some.places[i + 1]):
                    # least * positive <= 100 * negative <= most * positive
                    low, high = -(-least * some.wanted[k] // 100), most * some.wanted[k] // 100
                    start = np.searchsorted(ranked, -high, "left")
                    first = order[start : min(np.searchsorted(ranked, -low, "right"), start + negatives)]
                    same = [np.full(len(first), x) for x in (own, some.others[k], some.wanted[k])]
                    found.append(np.stack([*same, some.ids[first], some.scores[first, i]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, 1)], names=columns)

    found = met.select(*MET).mapInArrow(best, ", ".join(f"{c} bigint" for c in columns))
    first = _first(found, ["anchor", "positive", "positive_score"], negatives)
    return first.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
