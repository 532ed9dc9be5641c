"""Near-duplicate vectors by product quantisation with exact rerank.

Index. Coarse centres and the codebooks of the residual's subspaces are fitted on a
bounded sample. Every vector goes to the inverted list of its nearest centre, as one
byte per subspace together with the exact error of that code. Equal vectors of a label
are one entry with a count.

Search. Unit vectors with cosine c are at most sqrt(2 - 2c) = reach apart. A vector
probes each list whose Voronoi border is within reach, and whose radius allows it, which
cannot lose a partner. In a probed list the asymmetric distance to the coded vector comes
from look-up tables; by the triangle inequality a partner is no further than reach plus
its coding error. What passes is reranked by the exact cosine in double precision. So
the probes are sufficient and no link is lost, whatever the sample was.

Lists are packed into blocks of bounded size; a task compares one pair of blocks, never a
whole label. Two blocks meet only if some list of one comes within reach of some list of the
other, by the distance of their centres and the radii. Links are counted for both ends as they are
found, a chunk at a time, and a spanning forest of them is joined to components.

Each length of vectors has an index of its own, as vectors of different lengths have no cosine.

Defined cases: vectors that are null, zero, or hold nulls or non-finite numbers link
with nothing, as do those without label or id. Repeated rows
are rows of their own: each counts as another vector. Rows without id have no component
and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.llm.common import append_columns, named
from tillview.llm.components import connected
from tillview.sources.scratch import materialize

SIMILARITY = 0.93
#: Vectors that the index is fitted on, at most.
SAMPLE_VECTORS = 16_384
CENTRES = 64
SUBSPACES = 8
CODES = 256
ROUNDS = 8
#: Bytes of vectors in a block; two blocks meet in a task.
BLOCK_BYTES = 2 << 20
SLACK = 1e-6


def _means(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from evenly drawn starting points."""
    k = min(k, len(points))
    centres = points[np.random.default_rng(7).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(p, centres).argmin(1) for p in np.array_split(points, max(1, len(points) // 4096))])


def _parts(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


class Quantiser:
    """Coarse centres and residual codebooks."""

    def __init__(self, sample: np.ndarray):
        self.width = sample.shape[1]
        self.parts = _parts(self.width)
        self.centres = _means(sample, CENTRES)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [_means(residual[:, p], CODES) for p in self.parts]

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, error of the code and distance to the centre."""
        lists = _nearest(points, self.centres)
        residual = points - self.centres[lists]
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return lists, codes, np.linalg.norm(residual - decoded, axis=1), np.linalg.norm(residual, axis=1)

    def probes(self, points: np.ndarray, reach: float) -> np.ndarray:
        """Whether a partner of a point can lie in a list: the border of its cell is within reach."""
        squares = _squares(points, self.centres)
        own = squares.argmin(1)
        apart = np.sqrt(np.maximum(_squares(self.centres, self.centres), 1e-12))[own]
        border = (squares - squares[np.arange(len(points)), own][:, None]) / (2 * apart)
        allowed = border <= reach + SLACK
        allowed[np.arange(len(points)), own] = True
        return allowed


def _unit_entries(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(gid, label, v, low, rows, unit, width): the different usable vectors; equal ones are one entry."""
    wide = F.transform(named(vector), lambda x: x.cast("double"))
    usable = (
        named(key).isNotNull()
        & named(label).isNotNull()
        & named(vector).isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    # divided by the largest part first, so squares neither overflow nor vanish
    top = F.array_max(F.transform("v", F.abs))
    rows = (
        vectors.withColumns({"v": wide})
        .where(usable & (F.size("v") > 0))
        .select(named(key).cast("bigint").alias("id"), named(label).alias("label"), "v", top.alias("top"))
        .where(F.col("top") > 0)
    )
    entries = rows.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("rows"), F.first("top").alias("top"))
    scaled = entries.withColumn("s", F.transform("v", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda total, x: total + x * x))
    return scaled.select(
        F.monotonically_increasing_id().alias("gid"),
        "label",
        "v",
        "low",
        "rows",
        F.transform("s", lambda x: x / norm).alias("unit"),
        F.size("v").alias("width"),
    )


def fit(entries: DataFrame, width: int) -> Quantiser:
    """The quantiser, from at most SAMPLE_VECTORS entries with the smallest hashes."""
    rows = (
        entries.where(F.col("width") == width)
        .select("unit", F.xxhash64("gid").alias("order"))
        .orderBy("order")
        .limit(SAMPLE_VECTORS)
        .select("unit")
        .toArrow()
    )
    return Quantiser(_matrix(rows.column("unit").combine_chunks(), width))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def build_index(entries: DataFrame, model: Quantiser) -> DataFrame:
    """Every entry with its list, its code, the code's error and its distance to the centre."""
    shared = entries.sparkSession.sparkContext.broadcast({"model": vars(model)})
    width = model.width
    fields = [
        T.StructField("list", T.IntegerType()),
        T.StructField("code", T.BinaryType()),
        T.StructField("error", T.DoubleType()),
        T.StructField("far", T.DoubleType()),
    ]

    def make(units: pa.Array) -> list[pa.Array]:
        lists, codes, error, far = _model(shared.value).encode(_matrix(units, width))
        return [
            pa.array(lists, pa.int32()),
            pa.array([c.tobytes() for c in codes], pa.binary()),
            pa.array(error, pa.float64()),
            pa.array(far, pa.float64()),
        ]

    usual = entries.where(F.col("width") == width).select("gid", "label", "rows", "unit")
    return append_columns(usual, ["unit"], fields, make)


def _model(state: dict) -> Quantiser:
    if "built" not in state:
        state["built"] = Quantiser.__new__(Quantiser)
        vars(state["built"]).update(state["model"])
    return state["built"]


def _blocks(index: DataFrame, width: int) -> DataFrame:
    """(label, block, content): entries of neighbouring lists packed into blocks of bounded size."""
    most = max(64, BLOCK_BYTES // (8 * width))
    sizes = index.groupBy("label", "list").count()
    # whole lists are packed together, a longer list is cut by hash; a label has at most CENTRES rows here
    before = F.sum("count").over(Window.partitionBy("label").orderBy("list"))
    plan = sizes.select(
        "label",
        "list",
        F.when(F.col("count") > most, F.ceil(F.col("count") / most)).otherwise(1).cast("int").alias("cuts"),
        F.floor((before - F.col("count")) / most).cast("int").alias("pack"),
    )
    placed = index.join(plan, ["label", "list"])
    cut = F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("gid", F.lit("cut")), F.col("cuts")) + 1).otherwise(0)
    name = F.struct(
        F.when(F.col("cuts") > 1, F.lit(-1)).otherwise(F.col("pack")).alias("pack"),
        F.when(F.col("cuts") > 1, F.col("list")).otherwise(-1).alias("list"),
        cut.alias("cut"),
    )
    rows = placed.select("label", F.xxhash64(name).alias("block"), "gid", "rows", "unit", "list", "code", "error", "far")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["list", "gid"])
        radii = frame.groupby("list")["far"].max()
        return pd.DataFrame(
            {
                "label": [frame["label"].iloc[0]],
                "block": [frame["block"].iloc[0]],
                "gids": [frame["gid"].to_numpy("<i8").tobytes()],
                "rows": [frame["rows"].to_numpy("<i8").tobytes()],
                "units": [np.stack(frame["unit"].to_list()).astype("<f8").tobytes()],
                "lists": [frame["list"].to_numpy("<i4").tobytes()],
                "codes": [b"".join(frame["code"])],
                "errors": [frame["error"].to_numpy("<f8").tobytes()],
                "fars": [frame["far"].to_numpy("<f8").tobytes()],
                "cells": [radii.index.to_numpy("<i4").tobytes()],
                "radii": [radii.to_numpy("<f8").tobytes()],
            }
        )

    label_type = index.schema["label"].dataType.simpleString()
    binary = ", ".join(f"{n} binary" for n in ("gids", "rows", "units", "lists", "codes", "errors", "fars", "cells", "radii"))
    return rows.groupBy("label", "block").applyInPandas(pack, f"label {label_type}, block bigint, {binary}")


class Block:
    """A packed block, unpacked."""

    def __init__(self, packed: dict, width: int):
        self.gids = np.frombuffer(packed["gids"], "<i8")
        self.rows = np.frombuffer(packed["rows"], "<i8")
        self.units = np.frombuffer(packed["units"], "<f8").reshape(-1, width)
        self.lists = np.frombuffer(packed["lists"], "<i4")
        self.codes = np.frombuffer(packed["codes"], np.uint8).reshape(len(self.gids), -1)
        self.errors = np.frombuffer(packed["errors"], "<f8")
        self.fars = np.frombuffer(packed["fars"], "<f8")


def reach_of(similarity: float) -> float:
    """The largest distance of two unit vectors with that cosine."""
    return math.sqrt(max(0.0, 2 - 2 * similarity))


def search(model: Quantiser, left: Block, right: Block, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in left, j in right) of all pairs with cosine >= similarity, each pair of entries once, in runs."""
    reach = reach_of(similarity)
    same = left is right
    borders = np.flatnonzero(np.r_[True, right.lists[1:] != right.lists[:-1]])
    ends = np.r_[borders[1:], len(right.lists)]
    for start in range(0, len(left.gids), 256):
        rows = slice(start, min(start + 256, len(left.gids)))
        queries = left.units[rows]
        allowed = model.probes(queries, reach)
        to_centre = np.sqrt(np.maximum(_squares(queries, model.centres), 0))
        tables = [-2 * queries[:, p] @ b.T for p, b in zip(model.parts, model.books)]
        for begin, end in zip(borders, ends):
            cell = right.lists[begin]
            near = allowed[:, cell] & (to_centre[:, cell] <= right.fars[begin:end].max() + reach + SLACK)
            picked = np.flatnonzero(near)
            if not len(picked):
                continue
            # |q - c - r|^2 = |q - c|^2 - 2 q.r + 2 c.r + |r|^2, with r the coded residual
            codes, centre = right.codes[begin:end], model.centres[cell]
            fixed = sum(
                (2 * b @ centre[p] + (b**2).sum(1))[codes[:, m]] for m, (p, b) in enumerate(zip(model.parts, model.books))
            )
            squares = to_centre[picked, cell][:, None] ** 2 + fixed[None]
            for m, table in enumerate(tables):
                squares += table[picked][:, codes[:, m]]
            i, j = np.nonzero(squares <= (reach + right.errors[begin:end] + SLACK)[None] ** 2)
            i, j = picked[i] + start, j + begin
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65_536):
                a, b = i[k : k + 65_536], j[k : k + 65_536]
                close = np.einsum("ij,ij->i", left.units[a], right.units[b]) >= similarity
                yield a[close], b[close]


class Forest:
    """A spanning forest of links that arrive in runs: enough of them for the components."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.root[i] != self.root[j]
        i, j = i[apart], j[apart]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for begin, end in zip(edges, [*edges[1:], len(i)]):
            x, others = i[begin], j[begin:end]
            roots, first = np.unique(self.root[others], return_index=True)
            new = roots != self.root[x]
            if new.any():
                self.links += [(int(x), int(y)) for y in others[first[new]]]
                joined = np.zeros(len(self.root), bool)
                joined[roots[new]] = True
                self.root[joined[self.root]] = self.root[x]


def block_pairs(blocks: DataFrame, shared: Broadcast, similarity: float) -> DataFrame:
    """(label, block, other): the pairs of a label's blocks with lists within reach of each other; no contents are moved."""
    reach = reach_of(similarity)
    names = blocks.select("label", "block", "cells", "radii")
    others = names.select("label", *(F.col(c).alias(f"other_{c}") for c in ("block", "cells", "radii")))
    pairs = names.join(others, "label").where(F.col("block") <= F.col("other_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _model(shared.value).centres
        apart = np.sqrt(np.maximum(_squares(centres, centres), 0))
        for batch in batches:
            cells, others = batch.column("cells").to_pylist(), batch.column("other_cells").to_pylist()
            radii, other_radii = batch.column("radii").to_pylist(), batch.column("other_radii").to_pylist()
            near = [
                bool(
                    (
                        apart[np.ix_(np.frombuffer(c, "<i4"), np.frombuffer(o, "<i4"))]
                        <= np.frombuffer(r, "<f8")[:, None] + np.frombuffer(s, "<f8")[None] + reach + SLACK
                    ).any()
                )
                for c, o, r, s in zip(cells, others, radii, other_radii)
            ]
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("label"), kept.column("block"), kept.column("other_block")], names=["label", "block", "other"]
            )

    label_type = blocks.schema["label"].dataType.simpleString()
    return pairs.mapInArrow(run, f"label {label_type}, block bigint, other bigint")


def link(entries: DataFrame, model: Quantiser, similarity: float) -> DataFrame:
    """(gid, other, links): per block pair the links of each entry as a count, and a forest of them as pairs."""
    shared = entries.sparkSession.sparkContext.broadcast({"model": vars(model)})
    width = model.width
    index = materialize(build_index(entries, model), "index")
    blocks = materialize(_blocks(index, width), "blocks")
    pairs = block_pairs(blocks, shared, similarity)
    columns = ["gids", "rows", "units", "lists", "codes", "errors", "fars"]
    left = blocks.select("label", "block", F.struct(*columns).alias("left"))
    right = blocks.select("label", F.col("block").alias("other"), F.struct(*columns).alias("right"))
    met = pairs.repartition("label", "block", "other").join(left, ["label", "block"]).join(right, ["label", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a = Block(row["left"], width)
                b = a if row["block"] == row["other"] else Block(row["right"], width)
                # places of both blocks in a row; a block that meets itself has its places once
                gids = a.gids if a is b else np.r_[a.gids, b.gids]
                shift = 0 if a is b else len(a.gids)
                counts, forest = np.zeros(len(gids), np.int64), Forest(len(gids))
                for i, j in search(_model(shared.value), a, b, similarity):
                    # every row of one entry is linked with every row of the other
                    np.add.at(counts, i, b.rows[j])
                    np.add.at(counts, j + shift, a.rows[i])
                    forest.add(i, j + shift)
                linked = np.flatnonzero(counts)
                tree = np.array(forest.links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[gids[linked], gids[tree[:, 0]]], pa.int64()),
                        pa.array([None] * len(linked) + gids[tree[:, 1]].tolist(), pa.int64()),
                        pa.array(np.r_[counts[linked], np.zeros(len(tree), np.int64)], pa.int64()),
                    ],
                    names=["gid", "other", "links"],
                )

    return met.select("block", "other", "left", "right").mapInArrow(run, "gid bigint, other bigint, links bigint")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id``, ``kept``."""
    entries = materialize(_unit_entries(vectors, key, vector, label), "entries")
    widths = [r["width"] for r in entries.select("width").distinct().orderBy("width").collect()]
    own = named(key).cast("bigint")
    if not widths:
        return vectors.select(
            named(key), F.lit(0).cast("bigint").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept")
        )
    # one index per width: vectors of different widths have no cosine
    each = [link(entries, fit(entries, width), similarity) for width in widths]
    links = materialize(reduce(DataFrame.union, each), "links")
    counted = links.where(F.col("other").isNull()).groupBy("gid").agg(F.sum("links").alias("links"))
    roots = connected(links.where(F.col("other").isNotNull()), "gid", "other")
    placed = entries.drop("unit", "width").join(roots.withColumnRenamed("node", "gid"), "gid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "gid"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    found = (
        placed.join(lowest, "root")
        .join(counted, "gid", "left")
        .select(
            F.col("label").alias("entry_label"),
            "v",
            (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
            F.col("component").alias("component_id"),
        )
    )
    wide = F.when(own.isNotNull(), F.transform(named(vector), lambda x: x.cast("double")))
    rows = vectors.select(named(key).alias("id"), own.alias("own"), named(label).alias("label"), wide.alias("w"))
    # a vector with very many copies meets its one entry: the skew join splits it
    joined = rows.join(found, (F.col("label") == F.col("entry_label")) & (F.col("w") == F.col("v")), "left")
    component = F.coalesce("component_id", "own")
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("own") == component, F.lit(True)).alias("kept"),
    )
