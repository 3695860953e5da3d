"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id and, where ids repeat or are null, by
digest: quantiles of a sample that is drawn by bytes and by the records' own
hashes give the shard borders, so a rerun makes the same shards. Each shard is one
task, which regenerates record headers, HTTP headers and digests, compresses
record by record and rolls to the next file once the compressed size is
reached. A file is written under a temporary name and renamed; the job's
manifest, a table of its own, is written last and lists every file. Readers
go by the manifest, so files of failed or repeated tasks are never read, and
a repeated task writes the same bytes.

Of records with equal payloads the one with the largest page id is the
response; the others are revisits that carry its headers and refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm.common import new_stage_path, shared_fs, spread_lookup, stage, text_or_empty, write_file

ROLL_BYTES = 32 * 1024 * 1024  # compressed size at which the next file begins
SHARD_BYTES = 64 * 1024 * 1024  # payload bytes a task writes, about
MAX_SHARDS = 16_384  # beyond, shards get larger
SAMPLES_PER_SHARD = 16  # expected number of sampled records
HEAD_BYTES = 800  # a record's own headers, about
NO_ID = -(2 ** 63)  # a null id is written first
DATE = "2024-01-01T00:00:00Z"  # a fixed date keeps reruns identical
_PAYLOAD_LEAST = 0  # bytes: smaller payloads are never revisits

MANIFEST = "shard int, file string, records long, bytes long, sha256 string, first_id long, last_id long"
_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()),
                       ("first_id", pa.int64()), ("last_id", pa.int64())])


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the 64 bits of the page id."""
    bits = (page_id if page_id is not None else 0) & (2**64 - 1)
    value = (bits >> 16) << 80 | 8 << 76 | ((bits >> 4) & 0xFFF) << 64 | 2 << 62 | (bits & 0xF) << 58 | (1 if page_id is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value & 1:
        return None
    bits = (value >> 80) << 16 | ((value >> 64) & 0xFFF) << 4 | ((value >> 58) & 0xF)
    return bits - 2**64 if bits >= 2**63 else bits


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, its header fields and digests regenerated from its content."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
              ("WARC-Target-URI", "".join(c for c in (url or "") if c >= " " and c != "\x7f")),
              ("WARC-Payload-Digest", "sha1:" + base32_digest(payload)), ("WARC-Block-Digest", "sha1:" + base32_digest(block))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _place(payload_digest: Column) -> Column:
    """(id, digest) of a record, in the order of the archive."""
    return F.struct(F.coalesce(F.col("id"), F.lit(NO_ID)).alias("id"), F.conv(F.substring(payload_digest, 1, 15), 16, 10).cast("long").alias("d"))


def shard_cuts(pages: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """Sorted first places of all shards but the first, at quantiles of a byte-weighted sample of (id, digest, bytes) rows.

    At most MAX_SHARDS * SAMPLES_PER_SHARD places, about, reach the driver at
    any input size. Only rows that repeat one id with one payload share a place.
    """
    size = F.col("bytes") + HEAD_BYTES
    total = pages.agg(F.sum(size)).first()[0] or 0
    shards = min(-(-total // shard_bytes), MAX_SHARDS)
    if shards < 2:
        return []
    chance = F.pmod(F.xxhash64("id", "digest"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    place = _place(F.col("digest"))
    drawn = sorted((r["id"], r["d"]) for r in pages.filter(chance < size * F.lit(shards * SAMPLES_PER_SHARD / total)).select(place.alias("p")).select("p.*").collect())
    return sorted({drawn[i * len(drawn) // shards] for i in range(1, shards)}) if drawn else []


def shard_of(place: Column, cuts: list[tuple[int, int]]) -> Column:
    """Number of cuts at or before the place, found in two short steps."""
    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= place))

    if not cuts:
        return F.lit(0)
    fan = max(int(len(cuts) ** 0.5), 1)
    blocks = [cuts[i:i + fan] for i in range(0, len(cuts), fan)]
    kind = "array<struct<id:bigint,d:bigint>>"
    # one literal, folded once: a literal per cut would swell the plan
    nested = F.from_json(F.lit(json.dumps([[{"id": i, "d": d} for i, d in b] for b in blocks])), f"array<{kind}>")
    block = below(F.from_json(F.lit(json.dumps([{"id": b[0][0], "d": b[0][1]} for b in blocks])), kind))
    return F.when(block == 0, 0).otherwise((block - 1) * fan + below(F.element_at(nested, F.greatest(block, F.lit(1)))))


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
          roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, least_bytes: int = _PAYLOAD_LEAST) -> DataFrame:
    """Writes the archives under ``folder`` and returns the manifest, itself a table in that folder.

    Null payloads and URLs count as empty; a null id is written first, under
    an id of its own; rows with one id and payload are all responses if that
    id is the payload's largest. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.encode(text_or_empty(payload_column), "UTF-8").alias("payload"))
    slim = stage(rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")), "warc-pages")
    cuts = shard_cuts(slim, shard_bytes)

    copies = slim.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("size")).filter("size > 1")
    copies = stage(copies, "warc-copies")  # payloads that occur again
    total = copies.agg(F.sum("size")).first()[0] or 0
    rows = rows.withColumn("digest", F.sha1("payload"))
    if total:
        rows = spread_lookup(rows, copies, "digest", "size", "id", total)
        refers = F.when((F.octet_length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    else:
        refers = F.lit(None).cast("long")
    rows = rows.select(shard_of(_place(F.col("digest")), cuts).cast("int").alias("shard"), "id", "url", "payload", refers.alias("refers_to"))
    rows = rows.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "url", "payload")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        written: list[dict] = []
        out, now = io.BytesIO(), {}

        def close() -> None:
            if now:
                data = out.getvalue()
                write_file(folder, now["file"], data, attempt)
                written.append(now | {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
                out.seek(0)
                out.truncate()
                now.clear()

        part = 0
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("shard", "id", "url", "payload", "refers_to")]):
                number, page, url, payload, refers_to = [x.as_py() for x in row]
                if now and now["shard"] != number:
                    close()
                    part = 0
                elif now and out.tell() >= roll_bytes:
                    close()
                    part += 1
                if not now:
                    now.update(shard=number, file=f"pages-{number:05d}-{part:05d}.warc.gz", records=0, first_id=page)
                out.write(_member(record(page, url, payload, refers_to)))
                now.update(records=now["records"] + 1, last_id=page)
        close()
        if written:
            yield pa.RecordBatch.from_pylist(written, schema=_MANIFEST)

    path = f"{folder.rstrip('/')}/manifest"
    rows.mapInArrow(roll, MANIFEST).write.mode("overwrite").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


class BadRecord(ValueError):
    """A record that is cut off or whose digest is not that of its content."""


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzip stream; one member is in memory at a time."""
    pending = b""
    while True:
        if not pending and not (pending := stream.read(1 << 20)):
            return
        inflate, data = zlib.decompressobj(31), []
        while not inflate.eof:
            data.append(inflate.decompress(pending))
            pending = inflate.unused_data
            if not inflate.eof and not (pending := stream.read(1 << 20)):
                raise BadRecord("the archive ends inside a record")
        whole = b"".join(data)
        cut = whole.index(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in whole[:cut].decode().split("\r\n")[1:])
        block = whole[cut + 4:cut + 4 + int(fields["Content-Length"])]
        if "sha1:" + base32_digest(block) != fields["WARC-Block-Digest"]:
            raise BadRecord(f"wrong digest in {fields['WARC-Record-ID']}")
        yield fields, block


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the files that the manifest lists; payload is null for revisits, and throughout unless asked for."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = shared_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path.rstrip('/')}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["WARC-Type"] == "revisit"
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != size or base32_digest(payload) != digest):
                            raise BadRecord(f"wrong payload in {fields['WARC-Record-ID']}")
                        rows.append({"page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size,
                                     "payload_digest": digest, "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
                                     "payload": payload if with_payload and not revisit else None})
                        held += len(payload) if with_payload else 100
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("file")
    parallel = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(parallel, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(records, READ)


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """What a new archive of ``pages`` in the shared folder says of each page."""
    folder = new_stage_path(spark, "warc")
    return read(write(pages, folder), folder)
