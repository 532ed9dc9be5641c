"""Line dedup by spread over sites.

A line that stands on MIN_SITES or more distinct sites is boilerplate. It stays in the
document with the smallest id that has it and goes everywhere else.

Lines first meet as two hashes in an aggregation that keeps the smallest and largest
site: whatever has one site only, which is nearly everything, ends there, in narrow
rows with map-side combine. For the rest each line gets a HyperLogLog sketch of its
sites, merged by aggregation. Estimates far from MIN_SITES decide; lines near it get an
exact distinct count. Removals are gathered per document and joined to the texts once.

Defined cases: a null text stays null and has no lines; an empty one has one empty
line. Lines are compared without blanks at either end; those without any letter or digit
(brackets, rules) stay, all others count, however short. A null site counts for no site. Lines of rows without an id count towards the
spread but stay. Repeated lines and rows of one document count once and share a fate. A
document may end up empty. All columns are kept; helper columns can't clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.llm.common import named
from tillview.sources.scratch import materialize

MIN_SITES = 3
#: A line without this says nothing that could be boilerplate.
SAYS_SOMETHING = r"[\p{L}\p{N}]"
#: log2 of the sketch's registers: a relative error of 1.6 %.
SKETCH_SIZE = 12
#: Estimates within this share of MIN_SITES, or half a site, are counted exactly.
NEAR = 0.1


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def line_key(line: Column) -> Column:
    """96 bits of hash, as one value."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def line_rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(doc, site, h, g): each different line of each row."""
    lines = F.filter(F.transform(F.split(named(text), "\n"), stripped), lambda x: x.rlike(SAYS_SOMETHING))
    keys = F.explode(F.array_distinct(F.transform(lines, line_key)))
    where = F.when(named(site).isNotNull(), F.xxhash64(named(site)))
    rows = docs.select(named(key).alias("doc"), where.alias("site"), keys.alias("line"))
    return rows.select("doc", "site", "line.h", "line.g")


def removals(docs: DataFrame, key: str, text: str, site: str, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc, gone): the lines that each document loses."""
    rows = line_rows(docs, key, text, site)
    spread = (
        rows.groupBy("h", "g")
        .agg(F.min("site").alias("first"), F.max("site").alias("last"), F.min("doc").alias("keeper"))
        .where(F.col("first") != F.col("last"))
        .select("h", "g", "keeper")
        if min_sites > 1
        else rows.groupBy("h", "g").agg(F.min("doc").alias("keeper"))
    )
    # written first: joined straight from its aggregation, the rows of a hot line couldn't be split
    met = materialize(rows.join(materialize(spread, "spread"), ["h", "g"]), "lines")
    # one row per line and site first: a line on few sites weighs no more for its many documents
    places = met.select("h", "g", "site").distinct()
    sketched = places.groupBy("h", "g").agg(F.hll_sketch_agg("site", SKETCH_SIZE).alias("sketch"))
    low = min(min_sites * (1 - NEAR), min_sites - 0.5)
    high = max(min_sites * (1 + NEAR), min_sites + 0.5)
    sized = materialize(
        sketched.select("h", "g", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") > low), "sizes"
    )
    near = sized.where(F.col("sites") < high).select("h", "g")
    counted = places.join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.count("site").alias("sites"))
    boilerplate = (
        sized.where(F.col("sites") >= high).select("h", "g").union(counted.where(F.col("sites") >= min_sites).select("h", "g"))
    )
    return (
        met.join(boilerplate, ["h", "g"], "left_semi")
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc")
        .agg(F.collect_set(F.struct("h", "g")).alias("gone"))
    )


def drop_boilerplate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` without boilerplate lines; ``counts`` names columns for lines met and removed."""
    gone = removals(docs, key, text, site, min_sites)
    known = set(docs.columns)
    mark = next(n for n in (f"gone_{i}" for i in range(len(known) + 1)) if n not in known)
    id_ = next(n for n in (f"doc_{i}" for i in range(len(known) + 1)) if n not in known)
    # written first, so that its size is known when the join with the texts is planned
    gone = materialize(gone.select(F.col("doc").alias(id_), F.col("gone").alias(mark)), "gone")
    joined = docs.join(gone, named(key) == F.col(id_), "left")
    lines = F.split(named(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(mark), line_key(stripped(x))))
    clean = F.when(F.col(mark).isNull(), named(text)).otherwise(F.array_join(kept, "\n"))
    columns = [clean.alias(c) if c == text else named(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        met = F.when(named(text).isNull(), 0).otherwise(F.size(lines))
        left = F.when(named(text).isNull(), 0).when(F.col(mark).isNull(), F.size(lines)).otherwise(F.size(kept))
        columns += [met.cast("bigint").alias(counts[0]), (met - left).cast("bigint").alias(counts[1])]
    return joined.select(columns)
