"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Signature. A text is the set of its five-word shingles, all of weight 1 however often
they stand there, since verification compares sets. Each shingle is a
Poisson process with its weight as rate; every arrival goes to a uniform register, which
keeps its earliest arrival. A shingle stops as soon as its next arrival is later than
the latest register. Two registers agree with the probability Jaccard similarity of
the sets.

Candidates. Texts with the same word sequence are one entry. Bands of registers make
buckets; entries of a bucket whose signatures agree in ESTIMATE or more are joined, and
the components of these joins are the candidate groups. A pair at SIMILARITY shares no
bucket with probability (1 - 0.8^4)^25 = 2e-6, and is less likely to be lost above it.

Verification. Within a candidate group all texts are compared by the exact Jaccard
similarity of their shingle sets; the links at SIMILARITY or above make the classes.

Both comparisons walk through a group breadth first: a text meets only those that no
class has yet, and a group gives one link per text, never its pairs. A large bucket or
group is split into parts by hash, and each pair of parts meets in a task of bounded
size, so no pair is left out.

Defined cases: null texts and those without a word are alone in their class, as are
rows without id. A text of fewer than five words is one shingle. Repeated rows and
copies share a class; rows with equal ids are one document. The class id is the
smallest id of the class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.llm import shingles
from tillview.llm.common import append_columns, named
from tillview.llm.components import connected
from tillview.sources.scratch import materialize

SIMILARITY = 0.8
BANDS, BAND_SIZE = 25, 4
REGISTERS = BANDS * BAND_SIZE
#: Signatures that agree less than this are no candidates; five deviations below SIMILARITY.
ESTIMATE = 0.6
#: Entries, and shingles, that a part of a bucket or group holds at most, about.
PART_ROWS = 2_048
PART_SHINGLES = 1_500_000

U = np.uint64
_STEP = U(0xD1342543DE82EF95)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (32 bits of the winning shingle) of weighted sets (hashes, weights)."""
    n = len(sets)
    values = np.zeros(n * m, np.uint32)
    if not n:
        return values.reshape(n, m)
    element = np.concatenate([e for e, _ in sets])
    rate = np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    earliest = np.full(n * m, np.inf)
    time, draw = np.zeros(len(element)), element.copy()
    while len(element):
        draw = draw + _STEP
        bits = shingles.mix(draw)
        uniform = ((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / rate
        slot = owner * m + (shingles.mix(bits ^ _STEP) % U(m)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        values[slot[won]] = (element[won] >> U(32)).astype(np.uint32)
        open_sets = np.unique(owner)
        limit = np.zeros(n)
        limit[open_sets] = earliest.reshape(n, m)[open_sets].max(axis=1)
        going = time < limit[owner]
        element, rate, owner, time, draw = element[going], rate[going], owner[going], time[going], draw[going]
    return values.reshape(n, m)


def sign(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``sequence`` (null if there is no word), ``n_shingles`` and ``signature``."""
    fields = [
        T.StructField("sequence", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("signature", T.BinaryType()),
    ]

    def make(texts: pa.Array) -> list[pa.Array]:
        keys: list[bytes | None] = []
        sizes: list[int] = []
        registers: list[bytes | None] = []
        for _, chunk in shingles.chunks(texts.to_pylist()):
            known: dict[bytes, int] = {}
            sets, place = [], []
            for words in shingles.word_hashes(chunk):
                if not len(words):
                    keys.append(None)
                    place.append(-1)
                    sizes.append(0)
                    continue
                key = shingles.sequence_key(words)
                if key not in known:
                    known[key] = len(sets)
                    found = np.unique(shingles.shingle_hashes(words))
                    sets.append((found, np.ones(len(found))))
                keys.append(key)
                place.append(known[key])
                sizes.append(len(sets[known[key]][0]))
            made = signatures(sets)
            registers += [None if p < 0 else made[p].tobytes() for p in place]
        return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(registers, pa.binary())]

    return append_columns(docs, [text], fields, make).drop(text)


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of one value of ``by`` each, from batches sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(by).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        part = pa.Table.from_batches([batch])
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if held and keys[begin] != last:
                yield pa.concat_tables(held)
                held = []
            last = keys[begin]
            held.append(part.slice(begin, end - begin))
    if held:
        yield pa.concat_tables(held)


def walk(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of 0..n-1; ``near(x, rest)`` says which of the places ``rest`` are linked with x."""
    rest, forest = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            linked = near(x, rest)
            reached = rest[linked]
            forest += [(x, int(y)) for y in reached]
            queue += reached.tolist()
            rest = rest[~linked]
    return forest


def _parts(members: DataFrame, group: str, weight: str) -> DataFrame:
    """``members`` with ``cell``: one per group, or one per pair of parts of a large group."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n_"), F.sum(weight).alias("w_")).where(F.col("n_") > 1)
    cut = F.greatest(F.ceil(F.col("n_") / PART_ROWS), F.ceil(F.col("w_") / PART_SHINGLES), F.lit(1)).cast("int")
    joined = members.join(sizes.select(group, cut.alias("cuts_")), group)
    own = F.pmod(F.xxhash64("gid", group), F.col("cuts_")).cast("int")
    # one part meets itself only where there is no other to meet
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("cuts_") - 1), lambda q: (F.col("cuts_") == 1) | (q != own)))
    named_ = joined.withColumn("own_", own).withColumn("other_", other)
    cell = F.xxhash64(group, F.least("own_", "other_"), F.greatest("own_", "other_"))
    return named_.withColumn("cell", cell).drop("own_", "other_", "cuts_")


def _forest(cells: DataFrame, columns: list[str], links: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): the links that ``links`` finds in each cell, as gids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for table in grouped(batches, "cell"):
            gids = table.column("gid").to_numpy()
            for x, y in links(table):
                a.append(int(gids[x]))
                b.append(int(gids[y]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = cells.select("cell", "gid", *columns).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _signature_links(table: pa.Table) -> list[tuple[int, int]]:
    registers = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return walk(table.num_rows, lambda x, rest: (registers[rest] == registers[x]).mean(axis=1) >= ESTIMATE)


def _set_links(similarity: float) -> Callable[[pa.Table], list[tuple[int, int]]]:
    def links(table: pa.Table) -> list[tuple[int, int]]:
        sets = [np.frombuffer(s, "<u8") for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        marked = np.zeros(ids.max() + 1, bool)

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            small, large = np.minimum(sizes[x], sizes[rest]), np.maximum(sizes[x], sizes[rest])
            out = small >= similarity * large  # otherwise the sizes alone keep them apart
            places = rest[out]
            if len(places):
                own = ids[starts[x] : starts[x + 1]]
                marked[own] = True
                common = np.array([np.count_nonzero(marked[ids[starts[y] : starts[y + 1]]]) for y in places])
                marked[own] = False
                out[out] = common >= similarity * (sizes[x] + sizes[places] - common)
            return out

        return walk(len(sets), near)

    return links


def _shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(gid, group, shingles, n_shingles) of the wanted entries, from the text of one document each."""
    rows = docs.select(named(key).cast("bigint").alias("low"), named(text).alias("body")).where(F.col("body").isNotNull())
    fields = [T.StructField("shingles", T.BinaryType()), T.StructField("same", T.BinaryType())]

    def make(texts: pa.Array) -> list[pa.Array]:
        sets, keys = [], []
        for _, chunk in shingles.chunks(texts.to_pylist()):
            for words in shingles.word_hashes(chunk):
                keys.append(shingles.sequence_key(words))
                sets.append(np.unique(shingles.shingle_hashes(words)).astype("<u8").tobytes())
        return [pa.array(sets, pa.binary()), pa.array(keys, pa.binary())]

    read = append_columns(rows.join(wanted, "low"), ["body"], fields, make)
    # an id that stands on several texts brings them all; repeated rows bring one text twice
    own = read.where(F.col("same") == F.col("sequence")).select("gid", "group", "shingles", "n_shingles")
    return own


def _classified(docs: DataFrame, key: str, text: str, similarity: float, *more: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, entries (word sequences) with their root, and the ``class_id`` of each root."""
    own = named(key).cast("bigint")
    signed = materialize(sign(docs.select(own.alias("doc"), named(text).alias("body"), *more), "body"), "signatures")
    usable = signed.where(F.col("doc").isNotNull() & F.col("sequence").isNotNull())
    lowest = usable.groupBy("sequence").agg(F.min("doc").alias("low"))
    first = usable.join(lowest.select(F.col("sequence").alias("s"), "low"), (F.col("sequence") == F.col("s")) & (F.col("doc") == F.col("low")))
    # repeated rows of the first document are one entry
    entries = first.select("sequence", "low", "n_shingles", "signature").distinct()
    entries = materialize(entries.withColumn("gid", F.monotonically_increasing_id()), "entries")

    width = BAND_SIZE * 4
    bands = F.explode(
        F.array(*(F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(BANDS)))
    )
    # a byte of each register is enough for the estimate
    short = F.unhex(F.regexp_replace(F.hex("signature"), "(..)......", "$1"))
    buckets = entries.select("gid", bands.alias("bucket"), F.lit(0).alias("none"))
    cells = _parts(buckets, "bucket", "none").select("cell", "gid").distinct()
    short_signatures = entries.select("gid", short.alias("short"))
    candidates = _forest(cells.join(short_signatures, "gid"), ["short"], _signature_links)
    groups = connected(materialize(candidates, "candidates"))

    wanted = entries.join(groups.withColumnRenamed("node", "gid"), "gid").select(
        "gid", "low", "sequence", "n_shingles", F.col("root").alias("group")
    )
    sets = _shingle_sets(docs, wanted, key, text)
    compared = _forest(_parts(materialize(sets, "sets"), "group", "n_shingles"), ["shingles"], _set_links(similarity))
    roots = connected(materialize(compared, "verified"))

    placed = entries.select("gid", "sequence", "low").join(roots.withColumnRenamed("node", "gid"), "gid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "gid"))
    return signed, placed, placed.groupBy("root").agg(F.min("low").alias("class_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, text_hash), distinct: one document of each class, told by id and text.

    It is the one with the smallest id; of several texts under that id, the one with the smallest
    key of its words, then of its text. Texts without words stand for themselves, rows without
    id are left out.
    """
    hashed = F.xxhash64(named(text)).alias("text_hash")
    signed, placed, smallest = _classified(docs, key, text, similarity, hashed)
    first = (
        placed.join(smallest, "root")
        .where(F.col("low") == F.col("class_id"))
        .groupBy("root", "low")
        .agg(F.min("sequence").alias("chosen"))
        .select(F.col("low").alias("chosen_doc"), "chosen")
    )
    rows = signed.where(F.col("doc").isNotNull()).select("doc", "text_hash", "sequence")
    stands = rows.join(first, (F.col("doc") == F.col("chosen_doc")) & (F.col("sequence") == F.col("chosen")), "left_semi")
    wordless = rows.where(F.col("sequence").isNull()).select("doc", "text_hash").distinct()
    return stands.groupBy("doc", "sequence").agg(F.min("text_hash").alias("text_hash")).drop("sequence").union(wordless)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: key, ``class_id``, ``kept`` (the document that stands for its class)."""
    signed, placed, smallest = _classified(docs, key, text, similarity)
    named_classes = placed.join(smallest, "root").select(F.col("sequence").alias("entry"), "class_id")
    # a text with very many copies meets its one entry: the skew join splits it
    every = signed.select("doc", F.when(F.col("doc").isNotNull(), F.col("sequence")).alias("sequence"))
    joined = every.join(named_classes, F.col("sequence") == F.col("entry"), "left")
    class_id = F.coalesce("class_id", "doc")
    return joined.select(
        F.col("doc").alias(key), class_id.alias("class_id"), F.coalesce(F.col("doc") == class_id, F.lit(True)).alias("kept")
    )
