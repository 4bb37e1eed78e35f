"""WARC archives written and read as chunked record tables.

A record never has to be in memory as a whole on the Python side: payloads travel as rows of
(record, chunk number, bytes), ``CHUNK`` bytes at most each. The writer streams the chunks of a
record into a gzip member of its archive. The reader gives the rows back, each with the length
and SHA-1 of the payload so far, so that the last chunk of a record carries its full digest.

Archives are written through Arrow's file systems to a folder that all executors share. A task
writes under a name of its own, and only the manifest of the finished write tells which
archives count: what a lost or repeated task leaves behind is never read.

Payloads of ``least`` bytes or more that are equal (SHA-1 and length) are kept once: the row with
the largest id is a ``response``, the others are ``revisit`` records that refer to it.

Cases: a null payload is an empty one. Rows with equal ids and equal payloads are all responses if
theirs is the largest id. A null id is below all others and is written as the empty string.
An empty table gives one archive without records, or none.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20
SALTS = 32
EOL = b"\r\n"
ID = "urn:page:"


def plan_records(pages: DataFrame, key: str, payload: str, least: int = 1000) -> DataFrame:
    """Id, payload, its length and digest, record type and ``refers_to`` of each row."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("bigint").alias("id"), body.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    same = (
        rows.where(F.col("n_bytes") >= least)
        .groupBy("digest", "n_bytes")
        .agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("times"))
        .where("times > 1 AND largest IS NOT NULL")
        .drop("times")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # A frequent payload is spread over salts; without a salt its rows would meet in one task.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    met = salted.join(same, ["digest", "n_bytes", "salt"], "left").drop("salt")
    refers = F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest"))
    return met.select("id", "payload", "n_bytes", "digest", refers.alias("refers_to"))


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as chunk rows; revisits have one row without bytes."""
    stored = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    last = F.greatest(F.ceil(stored / chunk) - 1, F.lit(0))
    cut = F.substring("payload", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk))
    return records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        "id",
        "chunk_no",
        (F.col("chunk_no") == last).alias("is_last"),
        F.when(F.col("refers_to").isNull(), cut).otherwise(F.lit(b"")).alias("bytes"),
        "n_bytes",
        "digest",
        "refers_to",
    )


def _header(row: dict) -> bytes:
    own = "" if row["id"] is None else row["id"]
    revisit = row["refers_to"] is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{own}>",
        f"WARC-Target-URI: {ID}{own}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"WARC-Payload-Length: {row['n_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else row['n_bytes']}",
    ]
    if revisit:
        lines += [
            f"WARC-Refers-To: <{ID}{row['refers_to']}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return EOL.join(x.encode() for x in [*lines, "", ""])


def write_archives(chunks: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the chunk rows as ``.warc.gz`` files below ``path``; returns the manifest.

    The chunk rows of a record must follow each other in a partition, as ``chunk_table`` leaves
    them. An archive is closed at the first record's end beyond ``archive_bytes``.
    """
    spark = chunks.sparkSession

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out = packer = None
        name, written, n_records = "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [f"{path}/{name}"], "n_records": [n_records], "n_bytes": [written]}, schema=manifest
            )

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(i) for i in range(len(names)))):
                row = {n: v.as_py() if n != "bytes" else v for n, v in zip(names, values)}
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written, n_records = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                if row["chunk_no"] == 0:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(_header(row)))
                piece = row["bytes"].as_buffer()
                out.write(packer.compress(piece) if piece is not None else b"")
                written += piece.size if piece is not None else 0
                if row["is_last"]:
                    out.write(packer.compress(EOL + EOL) + packer.flush())
                    n_records += 1
                    if written >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    manifest = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
    done = f"{path}/manifest"
    schema = "archive string, n_records bigint, n_bytes bigint"
    chunks.mapInArrow(run, schema).write.parquet(done)
    return spark.read.schema(schema).parquet(done)


class _Stream:
    """Bytes of a gzip file of many members, inflated as they are asked for."""

    def __init__(self, source):
        self.source, self.unpack, self.have, self.ended = source, None, bytearray(), False

    def fill(self, n: int) -> bool:
        """Tries to have ``n`` bytes ready."""
        while len(self.have) < n and not self.ended:
            rest = self.unpack.unused_data or self.unpack.unconsumed_tail if self.unpack else b""
            if self.unpack is None or self.unpack.eof:
                data = rest or self.source.read(CHUNK)
                if not data:
                    self.ended = True
                    break
                self.unpack = zlib.decompressobj(31)
            else:
                data = rest or self.source.read(CHUNK)
                if not data:
                    raise EOFError("archive ends within a record")
            self.have += self.unpack.decompress(data, CHUNK)
        return len(self.have) >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def line(self) -> bytes | None:
        at = self.have.find(EOL)
        while at < 0:
            if not self.fill(len(self.have) + 1):
                return None
            at = self.have.find(EOL)
        return self.take(at + 2)[:-2]


def parse_archive(source, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one open archive: headers, bytes, length and digest so far."""
    stream = _Stream(source)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields: dict[str, str] = {}
        while line := stream.line():
            field, _, value = line.decode().partition(":")
            fields[field.strip().lower()] = value.strip()
        length, digest, so_far, number = int(fields["content-length"]), hashlib.sha1(), 0, 0
        while True:
            data = stream.take(min(chunk, length - so_far))
            if not data and so_far < length:
                raise EOFError("archive ends within a payload")
            digest.update(data)
            so_far += len(data)
            yield {
                "fields": fields,
                "chunk_no": number,
                "bytes": data,
                "bytes_so_far": so_far,
                "digest_so_far": digest.hexdigest(),
                "is_last": so_far >= length,
            }
            number += 1
            if so_far >= length:
                break


CHUNK_ROWS = pa.schema(
    [
        ("id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("chunk_no", pa.int64()),
        ("bytes", pa.binary()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("is_last", pa.bool_()),
        ("stated_digest", pa.string()),
        ("stated_bytes", pa.int64()),
    ]
)


def _id(value: str | None) -> int | None:
    own = (value or "").strip("<>").removeprefix(ID)
    return int(own) if own else None


def read_archives(manifest: DataFrame, with_bytes: bool = True, flush: int = 4 << 20) -> DataFrame:
    """Chunk rows of all archives of the manifest; without ``with_bytes`` only what tells of them."""
    kinds = {"int64": "bigint", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds.get(str(f.type), f.type)}" for f in CHUNK_ROWS)
    names = manifest.select("archive")

    def run(batches):
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path, compression=None) as source:
                    for x in parse_archive(source):
                        f = x.pop("fields")
                        size += len(x["bytes"]) + 200
                        if not with_bytes:
                            x["bytes"] = None
                        rows.append(
                            x
                            | {
                                "id": _id(f.get("warc-record-id")),
                                "record_type": f["warc-type"],
                                "refers_to": _id(f.get("warc-refers-to")),
                                "stated_digest": f.get("warc-payload-digest", "").partition(":")[2],
                                "stated_bytes": int(f.get("warc-payload-length", "0")),
                            }
                        )
                        if size >= flush:
                            yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_ROWS)
                            rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_ROWS)

    n = max(1, min(manifest.count(), 10_000))
    return names.repartition(n).mapInArrow(run, schema)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record. Its bytes and digest are those that were read, not those stated.

    A revisit has no bytes of its own: its length and digest are what its header states.
    """
    read = F.col("record_type") == "response"
    return chunks.where("is_last").select(
        "id",
        F.when(read, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(read, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
