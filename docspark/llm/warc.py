"""Dictionary-compressed WARC archives.

Pages become WARC records, equal payloads revisit records.  Each task writes archives of bounded size: it
builds a Zstandard dictionary from the archive's own records, embeds it (compressed) in a leading skippable
frame and compresses every record as a frame of its own.  Archives get names of their own and are listed in a
manifest that Spark commits, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import sys
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, scratch_dir, scratch_table

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of uncompressed records per archive, and of its dictionary.
ARCHIVE_BYTES, DICT_BYTES = 16_000_000, 65_536
#: Fixed value: the magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
_DATE = "1970-01-01T00:00:00Z"


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest (hex), payload_bytes, refers_to (null for responses).

    Of rows with equal payloads of `min_bytes` or more, the largest page_id is the response (rows that repeat
    that id too), others refer to it.  Null page_ids are the smallest.  Only the digests of payloads that several rows
    have are joined back, broadcast if they are counted to be few, so payloads don't move; as counts per payload
    are made before the shuffle, a payload that many rows share is no hot key there.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumns({"digest": F.sha1(payload), "payload_bytes": F.octet_length("html").cast("long")})
    shared = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes)
    shared = shared.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    shared = scratch_table(shared, "shared")
    joined = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS // 4 else shared, "digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("html")).alias("html"), "digest", "payload_bytes", F.when(revisit, F.col("keeper")).alias("refers_to"))


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, html: str | None, digest: str, payload_bytes: int, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    revisit = refers_to is not None
    payload = b"" if revisit else (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], dict_bytes: int = DICT_BYTES, level: int = 3) -> bytes:
    """An archive: the skippable frame with the dictionary, then a frame per record.

    Where the records are too few or too small to train a dictionary, their beginnings are one.
    """
    out = io.BytesIO()
    try:
        trained = zstandard.train_dictionary(min(dict_bytes, max(256, sum(map(len, records)) // 10)), records, k=512, d=8, f=18, accel=4)
    except zstandard.ZstdError:
        trained = zstandard.ZstdCompressionDict(b"".join(r[: dict_bytes // len(records) + 8] for r in records)[:dict_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
    out.write(struct.pack("<II", DICT_MAGIC, len(frame)) + frame)
    trained.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    start, trained = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size]))
        start = 8 + size
    lib = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(lib.stream_reader(io.BytesIO(archive[start:]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record isn't closed")
        yield head, block


def write(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of `pages` (page_id, url, html) under `folder` (a URI all executors reach); returns their manifest (path, n_records, n_bytes).

    A null html is an empty payload, a null URL leaves the field out.  An empty table writes no archive.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{uuid.uuid4().hex}.warc.zst"
            data = pack(held)
            with fs.open_output_stream(f"{base}/{path}", compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(held)], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() if c != "html" else batch[c] for c in ("page_id", "url", "html", "digest", "payload_bytes", "refers_to"))):
                held.append(record(row[0], row[1], row[2].as_py(), *row[3:]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    rows = classify(pages, min_bytes).sortWithinPartitions("digest")
    return scratch_table(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html of every archived record.

    A response's length and digest come from its payload, which must agree with its header; a revisit's from its header.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        urn = lambda s: None if s is None or s == "<urn:page:>" else s[10:-1]
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("html", pa.string())])

        def rows(path: str) -> Iterator[tuple]:
            with fs.open_input_file(f"{base}/{path}") as f:
                archive = f.read()
            for head, block in unpack(archive):
                http, _, payload = block.partition(b"\r\n\r\n")
                size, digest, kind = int(http.rsplit(b": ", 1)[1]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} isn't what its header says")
                yield urn(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind, urn(head.get("WARC-Refers-To")), payload.decode() if kind == "response" else None

        for batch in batches:
            for path in batch["path"].to_pylist():
                held: list[tuple] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = manifest.select("path").repartition(parts, "path").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
    return found.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared folder."""
    base = scratch_dir(spark)
    return f"{base if '://' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
