"""WARC records in ZIP packages: written by Spark tasks, found again through the ZIP directories, read by range.

A package holds stored (not deflated) members: ``archive/data.warc.gz`` with one gzip member per record, and
``indexes/index.cdx`` with a line (offset, length) per record. The reader looks at the end of a package, follows the
ZIP64 locator where there is one, walks the central directory to the stored members, takes the record ranges from the index
and hands them to tasks in pieces of bounded size; each task reads its ranges in place. Nothing is extracted and no package
is read whole.

Equal payloads of at least 100 bytes are written once: the record of the smallest id is the response, others are revisits
that name it and carry digest and length of the payload in their headers. Packages lie in the shared folder and are named by
partition and attempt; a task that is run again writes another file, and the manifest, written when all are done,
names those that count.

Defined cases: a null payload is empty; a null id is kept and is never the one referred to unless all are null; rows that
share the smallest id are all responses; an empty table gives no packages and an empty result; extra columns are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import new_path, query, stage
from fieldtrace.session import configure

LEAST_SHARED = 100
#: Bytes of records that one reading row stands for.
PIECE = 8 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGES = "path string, n_records long, bytes long"
RECORDS = ("id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary")
ZIP64 = 0xFFFFFFFF


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, uri, payload, refers_to): refers_to is the id of the response that a revisit repeats, else null.

    Digests are grouped alone, pre-aggregated in the map tasks; only those met twice go back to the rows, so the payloads
    move once, and the rows of a very common payload can be split by the planner.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("uri"),
                        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    groups = stage(base.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest")
                   .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "digests")
    other = F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull())
    return base.join(groups, "digest", "left").select("id", "uri", "payload", F.when(other, F.col("first")).alias("refers_to"))


def _record(row: dict) -> bytes:
    payload, to = row["payload"], row["refers_to"]
    kind = "response" if to is None else "revisit"
    uri = (row["uri"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row['id']} {uri}')}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
            ("X-Payload-Length", str(len(payload))), ("X-Row-Id", "" if row["id"] is None else str(row["id"]))]
    if to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Row-Id", str(to))]
    body = payload if to is None else b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 1, mtime=0)


class _Package:
    """A ZIP file of stored members, written front to back; sizes stand behind the data, and in ZIP64 fields."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        # version 4.5, sizes follow the data (flag 8), stored
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 8, 0, 0, 33, 0, 0, 0, len(name), 0) + name.encode())

    def data(self, data: bytes) -> None:
        member = self.members[-1]
        member[2], member[3] = zlib.crc32(data, member[2]), member[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 8, 0, 0, 33, crc, ZIP64, ZIP64, len(name), len(extra), 0, 0, 0, 0, ZIP64) + name + extra)
        size, directory_end = self.at - start, self.at
        n = len(self.members)
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, directory_end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, ZIP64, ZIP64, 0))


def _write(batches: Iterator[pa.RecordBatch], folder: str):
    """Write the rows of a partition as one package."""
    package, index, n, path = None, io.BytesIO(), 0, f"{folder}/{uuid.uuid4().hex}.zip"
    store, inner = fs.FileSystem.from_uri(path)
    for batch in batches:
        for row in batch.to_pylist():
            if package is None:
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                package = _Package(store.open_output_stream(inner))
                package.begin(WARC)
            record = _record(row)
            index.write(b"%d %d\n" % (package.members[0][3], len(record)))
            package.data(record)
            n += 1
    if package is not None:
        package.end()
        package.begin(INDEX)
        package.data(index.getvalue())
        package.end()
        package.close()
        package.out.close()
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "bytes": package.at}])


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """(path, n_records, bytes) of the packages written from (id, uri, payload, refers_to)."""
    return stage(records.mapInArrow(lambda b: _write(b, folder), PACKAGES), "manifest")


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, length) of a ZIP file's stored members; reads its end, its directory and their headers."""
    tail_at = max(0, size - 65_557)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if ZIP64 in (length, start) or n == 0xFFFF:
        mark, _, where, _ = struct.unpack_from("<4sIQI", tail, end - 20)
        if mark != b"PK\x06\x07":
            raise ValueError("ZIP64 locator is missing")
        source.seek(where)
        far = source.read(56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end of central directory is missing")
        n, length, start = struct.unpack_from("<QQQ", far, 32)
    source.seek(start)
    directory, at, out = source.read(length), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, plain, name_n, extra_n, note_n, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
        if mark != b"PK\x01\x02":
            raise ValueError("broken central directory")
        name, extra = directory[at + 46:at + 46 + name_n], directory[at + 46 + name_n:at + 46 + name_n + extra_n]
        at += 46 + name_n + extra_n + note_n
        while len(extra) >= 4:
            kind, m = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[4:4 + m // 8 * 8])]
                plain = wide.pop(0) if plain == ZIP64 else plain
                packed = wide.pop(0) if packed == ZIP64 else packed
                header = wide.pop(0) if header == ZIP64 else header
            extra = extra[4 + m:]
        if method == 0:
            source.seek(header)
            local = source.read(30)
            skip = sum(struct.unpack_from("<HH", local, 26))
            out[name.decode()] = (header + 30 + skip, packed)
    return out


def _pieces(batches, piece: int):
    """Per package the ranges of its records, in pieces of about so many bytes."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as source:
                found = members(source, source.size())
                for name in (m for m in found if m.startswith("indexes/")):
                    base, archive = found[name], found[WARC][0]
                    source.seek(base[0])
                    ranges, total = [], 0
                    for line in source.read(base[1]).splitlines():
                        at, n = map(int, line.split())
                        ranges.append((archive + at, n))
                        total += n
                        if total >= piece:
                            yield _piece(path, ranges)
                            ranges, total = [], 0
                    if ranges:
                        yield _piece(path, ranges)


def _piece(path: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
    lengths = pa.array([[n for _, n in ranges]], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[a for a, _ in ranges]], pa.list_(pa.int64())), lengths], names=["path", "starts", "lengths"])


def _parse(record: bytes) -> dict:
    data = gzip.decompress(record)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    payload = rest[:int(fields["Content-Length"])]
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError("payload does not match its digest")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {"id": number("X-Row-Id"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number("X-Refers-To-Row-Id"), "uri": fields["WARC-Target-URI"], "payload": payload}


def _read(batches, payloads: bool):
    schema = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("uri", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for piece in batch.to_pylist():
            store, inner = fs.FileSystem.from_uri(piece["path"])
            first, rows = piece["starts"][0], []
            with store.open_input_file(inner) as source:
                block = source.read_at(piece["starts"][-1] + piece["lengths"][-1] - first, first)  # one request for the piece
            for at, n in zip(piece["starts"], piece["lengths"]):
                row = _parse(block[at - first:at - first + n])
                rows.append(row if payloads else row | {"payload": None})
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_packages(packages: DataFrame, piece: int = PIECE, payloads: bool = True) -> DataFrame:
    """The records of all packages in the column ``path``: id, payload_bytes, payload_digest, record_type, refers_to, uri, payload."""
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few and small, the work behind each is not
    pieces = packages.select("path").repartition(parts, F.col("path")).mapInArrow(lambda b: _pieces(b, piece), "path string, starts array<long>, lengths array<long>")
    return pieces.repartition(parts, F.col("path"), F.col("starts")[0]).mapInArrow(lambda b: _read(b, payloads), RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", payloads: bool = True) -> DataFrame:
    """Write ``pages`` as packages and read the records back."""
    spark = configure(pages.sparkSession)
    packages = write_packages(decide(pages, id_col, url_col, payload_col), new_path(spark, "warc"))
    return read_packages(packages, payloads=payloads)


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN g.first IS NOT NULL AND d.page_id <> g.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> g.first THEN g.first END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 100
"""


@query("op7_zip_warc", SQL)
def op7_zip_warc(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
