"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing. Payloads are grouped by SHA-1. Of equal payloads of at least
MIN_REVISIT_BYTES bytes the row with the largest id becomes a ``response`` record and
the others ``revisit`` records that refer to it; smaller payloads are all responses. A
record is a gzip member of its own. Every task writes archives of bounded size and
returns one index row per record: archive, offset, length, url, payload digest. An
archive gets a name that no other attempt uses, and only the index, which Spark
commits, names archives; files of lost attempts are never read.

Reading. Selected index rows are dealt by archive and offset, so that neighbours meet
in one task in order; ranges less than a gap apart are fetched with one read of bounded
size. Records are parsed and the digests of responses are checked.

Defined cases: a null payload is an empty one; a null url is written without its
header and read back as null. Ids may be null (never the largest unless all of a
group are) and repeated; rows that share the largest id are all responses. An empty
table gives no archive and an empty index. Further columns of the table are left alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.llm.common import named
from tillview.sources.scratch import scratch_path

MIN_REVISIT_BYTES = 1_000
ARCHIVE_BYTES = 64 << 20
#: Ranges that lie closer than this are read together, in reads of READ_BYTES or one record.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Compressed bytes that a reading task fetches, about.
TASK_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "id bigint, url string, digest string, record_type string, archive string, offset bigint, length bigint"
RECORD_SCHEMA = (
    "id bigint, url string, record_type string, digest string, payload_bytes bigint, refers_to bigint, payload binary"
)


def with_roles(rows: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(id, url, payload, digest, size, winner): the winner is the id that a revisit refers to, else null.

    The winner of a digest comes from narrow rows with map-side combine; only payloads
    met again are looked up. A digest with very many rows is split by the skew join.
    """
    body = F.coalesce(named(payload), F.lit("")).cast("binary")
    read = rows.select(
        named(key).cast("bigint").alias("id"),
        named(url).cast("string").alias("url"),
        body.alias("payload"),
        F.sha1(body).alias("digest"),
        F.octet_length(body).cast("bigint").alias("size"),
    )
    winners = (
        read.where(F.col("size") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("id").alias("winner"), F.count("*").alias("met"))
        .where(F.col("met") > 1)
        .select("digest", "winner")
    )
    joined = read.join(winners, "digest", "left")
    winner = F.when(F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select("id", "url", "payload", "digest", "size", winner.alias("winner")).withColumn(
        "payload", F.when(F.col("winner").isNull(), F.col("payload"))
    )


def record_uri(key: int | None) -> str:
    return "urn:record:" + ("none" if key is None else str(key))


def record_bytes(key, url, payload, digest: str, size: int, winner) -> bytes:
    """One WARC/1.1 record with an HTTP head; a revisit has the head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if winner is not None else head + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if winner is None else 'revisit'}",
        f"WARC-Record-ID: <{record_uri(key)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",  # the table has no time of capture
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url))
    if winner is not None:
        lines += [f"WARC-Refers-To: <{record_uri(winner)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(record: bytes) -> bytes:
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(record) + member.flush()


def parse_record(content: bytes) -> tuple:
    """(id, url, record_type, digest, payload_bytes, refers_to, payload) of one unpacked record."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])

    def number(uri: str | None) -> int | None:
        last = uri.strip("<>").rpartition(":")[2] if uri else "none"
        return None if last == "none" else int(last)

    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url)
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        return number(fields["WARC-Record-ID"]), url, kind, digest, size, None, payload
    return number(fields["WARC-Record-ID"]), url, kind, digest, size, number(fields["WARC-Refers-To"]), None


def write_archives(rows: DataFrame, folder: str, key: str, url: str, payload: str) -> DataFrame:
    """Write the archives and the index under ``folder``, a path that all machines share; return the index.

    ``folder`` is a URI that pyarrow knows (file, hdfs, s3, gs) or a plain path.
    """
    spark = rows.sparkSession
    target = f"{folder}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, part, out, at = uuid.uuid4().hex, 0, None, 0
        system, root = fs.FileSystem.from_uri(target)
        schema = pa.schema(
            [("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]
            + [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
        )
        try:
            for batch in batches:
                columns = [batch.column(n) for n in ("id", "url", "payload", "digest", "size", "winner")]
                index = []
                for i in range(batch.num_rows):
                    key_, url_, payload_, digest, size, winner = (c[i].as_py() for c in columns)
                    record = packed(record_bytes(key_, url_, payload_, digest, size, winner))
                    if out is None or at + len(record) > ARCHIVE_BYTES and at:
                        if out is not None:
                            out.close()
                        part, at = part + 1, 0
                        name = f"{stem}-{part:05d}.warc.gz"
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(record)
                    kind = "response" if winner is None else "revisit"
                    index.append((key_, url_, digest, kind, name, at, len(record)))
                    at += len(record)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(list(zip(*index)) or [()] * len(schema), schema)], schema=schema
                )
        finally:
            if out is not None:
                out.close()

    index = with_roles(rows, key, url, payload).mapInArrow(write, INDEX_SCHEMA)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(T._parse_datatype_string(INDEX_SCHEMA)).parquet(f"{folder}/index")


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, by sorted and coalesced range reads."""
    target = f"{folder}/archives"
    schema = T._parse_datatype_string(RECORD_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(target)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [f.name for f in schema.fields]

        def fetch(archive: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            begin = ranges[0][0]
            with system.open_input_file(f"{root}/{archive}") as file:
                content = file.read_at(max(o + n for o, n in ranges) - begin, begin)
            found = [parse_record(zlib.decompress(content[o - begin : o - begin + n], 31)) for o, n in ranges]
            rows = [(*r[:6], r[6] if with_payload else None) for r in found]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        archive, ranges = None, []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(n).to_pylist() for n in ("archive", "offset", "length"))):
                if ranges:
                    end = ranges[-1][0] + ranges[-1][1]
                    if name != archive or offset > end + GAP_BYTES or offset + length - ranges[0][0] > READ_BYTES:
                        yield fetch(archive, ranges)
                        ranges = []
                archive = name
                ranges.append((offset, length))
        if ranges:
            yield fetch(archive, ranges)

    places = selected.select("archive", "offset", "length")
    # the index is small, what it points to is not: tasks are sized by the bytes they will fetch
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = places.repartitionByRange(size // TASK_BYTES + 1, "archive", "offset")
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(read, schema)


def round_trip(rows: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a table as archives and give every record as it is read back."""
    index = write_archives(rows, folder, key, url, payload)
    return read_records(index, folder, with_payload=False)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, as a URI."""
    path = scratch_path(spark, label)
    return path if re.match(r"[a-z0-9]+:/", path) else f"file://{path}"
