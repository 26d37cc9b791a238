"""Layers of encodings: to the end, url-safe base64, bombs and payloads that unfold to themselves."""

import base64
import gzip
import zlib

from pyspark.sql import functions as F

from fieldtrace.functions import content

TEXT = b"SELECT name FROM users WHERE id = 1 -- a plain text"


def names(found):
    return [s["encoding"] for s in found["steps"]]


def test_seven_layers(spark):
    data, wrap = TEXT, [gzip.compress, base64.b64encode, lambda d: d.hex().encode(), zlib.compress, base64.b64encode, lambda d: d.hex().encode(), base64.b64encode]
    for step in wrap:
        data = step(data)
    found = content._peel(data, "detect")
    assert found["data"] == TEXT and names(found) == ["base64", "hex", "base64", "deflate", "hex", "base64", "gzip"]
    row = spark.createDataFrame([(data,), (None,), (b"",), (b"plain",)], "p binary").select(content.decode_layers(F.col("p")).alias("d")).collect()
    assert bytes(row[0]["d"]["data"]) == TEXT and len(row[0]["d"]["steps"]) == 7 and row[1]["d"]["data"] is None and not row[3]["d"]["steps"]


def test_url_safe_base64():
    data = base64.urlsafe_b64encode(bytes(range(180, 256)) + TEXT)
    assert b"-" in data or b"_" in data
    assert content._peel(data.rstrip(b"="), "detect")["data"] == bytes(range(180, 256)) + TEXT
    for plain in (b"a-slug-of-many-small-words", b"MIXED_constant_NAME_of_some_sort", b"2024-01-01_2024-01-02_2024"):
        assert content._peel(plain, "detect") == {"data": plain, "steps": []}


def test_bombs_are_rejected():
    bomb = gzip.compress(bytes(50 << 20))
    found = content._peel(bomb, "detect")
    assert found["data"] == bomb and found["steps"][-1]["rejected"] and not found["steps"][-1]["success"]
    deep = gzip.compress(bytes(900_000) + TEXT)                       # small enough to be unfolded
    assert content._peel(deep, "detect")["data"].endswith(TEXT)
    assert content._inflate(gzip.compress(TEXT)[:-9], 31) is None      # cut off
    inside = base64.b64encode(bomb)
    assert [(s["encoding"], s["rejected"]) for s in content._peel(inside, "detect")["steps"]] == [("base64", False), ("gzip", True)]


def test_bomb_in_a_message(spark):
    from fieldtrace.operators import http
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n"
    row = http.decode_http_message(spark.createDataFrame([(head + gzip.compress(bytes(50 << 20)),)], "data binary")).first()
    assert [(s["encoding"], s["success"], s["rejected"]) for s in row["decode_steps"]] == [("gzip", False, True)] and len(row["body_final"]) < 100_000


def test_unfolding_to_itself_ends(monkeypatch):
    monkeypatch.setitem(content._UNDO, "gzip", lambda d, room=0: b"\x1f\x8b" + bytes([3 - d[2]]))
    assert len(content._peel(b"\x1f\x8b\x01", "detect")["steps"]) == 2


def test_batches_of_long_payloads_are_small(spark):
    """A batch is bounded by its bytes, so a worker's memory does not follow the length of the texts."""
    import pyarrow as pa

    from fieldtrace.session import configure
    configure(spark)

    @F.arrow_udf("long")
    def size(x: pa.Array) -> pa.Array:
        return pa.array([x.nbytes] * len(x), pa.int64())
    rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("t"))
    assert rows.select(size("t").alias("n")).agg(F.max("n")).first()[0] < 10 << 20
