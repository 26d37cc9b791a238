"""Undoing of content encodings: compression, percent, hex and base64 layers.

Which rows can carry an encoding at all is decided in the JVM; only those reach
Python, in Arrow batches.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = T.ArrayType(T.StructType([
    T.StructField("layer", T.IntegerType()), T.StructField("encoding", T.StringType()), T.StructField("input_size", T.LongType()),
    T.StructField("output_size", T.LongType()), T.StructField("success", T.BooleanType()), T.StructField("rejected", T.BooleanType())]))
DECODED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("steps", STEPS)])
BODY = T.StructType([*DECODED.fields, T.StructField("ended", T.BooleanType())])
_HEX = re.compile(rb"^[0-9a-fA-F]{20,}$")
_B64 = re.compile(rb"^[A-Za-z0-9+/=]{20,}$")
# base64 for addresses: its two signs also join ordinary words, so digits and both cases are asked for
_B64_URL = re.compile(rb"^(?=[^-_]*[-_])(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9_=-]{20,}$")
_PCT = re.compile(rb"%[0-9a-fA-F]{2}")
_ZLIB = (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")


def _entropy(data: bytes) -> float:
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    return float(-(share * np.log2(share)).sum())


#: Bytes that all layers of a payload may unfold to, and how many times its size a compressed layer may have.
MOST_OUTPUT, MOST_RATIO, RATIO_FROM = 64 << 20, 200, 1 << 20


class Bomb(ValueError):
    """A compressed layer that unfolds to more than is allowed."""


def _inflate(data: bytes, *modes: int, room: int = MOST_OUTPUT) -> bytes | None:
    """Decompress in one stream that stops as soon as the output is out of proportion."""
    most = min(room, max(RATIO_FROM, MOST_RATIO * len(data)))
    for mode in modes:
        stream = zlib.decompressobj(mode)
        try:
            out = stream.decompress(data, most + 1)
        except zlib.error:
            continue
        if len(out) > most:
            raise Bomb
        if stream.eof:
            return out
    return None


def _unhex(data: bytes) -> bytes | None:
    try:
        return binascii.unhexlify(data.decode("ascii", "ignore").replace("0x", "").replace("\\x", "").replace(" ", ""))
    except ValueError:
        return None


def _unbase64(data: bytes) -> bytes | None:
    packed = re.sub(rb"[\r\n ]", b"", data)
    packed += b"=" * (-len(packed) % 4)
    for signs in (None, b"-_"):
        try:
            return base64.b64decode(packed, altchars=signs, validate=True)
        except ValueError:
            continue
    return None


def _unquote(data: bytes) -> bytes:
    return unquote(data.decode("utf-8", "replace")).encode("utf-8")


_UNDO = {"gzip": lambda d, room=MOST_OUTPUT: _inflate(d, 31, room=room), "deflate": lambda d, room=MOST_OUTPUT: _inflate(d, 15, -15, room=room),
         "url": lambda d, room=0: _unquote(d), "hex": lambda d, room=0: _unhex(d), "base64": lambda d, room=0: _unbase64(d)}


def _detect(data: bytes) -> str | None:
    if len(data) < 2:
        return None
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:2] in _ZLIB:
        return "deflate"
    escapes = len(_PCT.findall(data))
    if escapes >= 5 or escapes / len(data) > 0.1:
        return "url"
    text = data.strip()
    if len(text) % 2 == 0 and _HEX.match(text):
        return "hex"
    return "base64" if _B64.match(text) or _B64_URL.match(text) else None


def _attempts(data: bytes, room: int):
    """The stricter encodings first: every hex string is also base64."""
    if data[:2] == b"\x1f\x8b":
        yield "gzip", _UNDO["gzip"](data, room)
    text = data.decode("ascii", "ignore").replace("0x", "").replace("\\x", "").replace(" ", "")
    if len(text) > 20 and re.fullmatch("[0-9a-fA-F]+", text):
        yield "hex", _unhex(data)
    if len(data) >= 20:
        out = _unbase64(data)
        yield "base64", out if out and _entropy(out) > 1.0 else None
    if data.count(b"%") > 3:
        yield "url", _unquote(data)


def _next_layer(data: bytes, mode: str, room: int) -> tuple[str, bytes | None] | None:
    if mode == "detect":
        encoding = _detect(data)
        return None if encoding is None else (encoding, _UNDO[encoding](data, room))
    for encoding, out in _attempts(data, room):
        if out and out != data:
            return encoding, out
    return None


def _peel(data: bytes | None, mode: str, layers: int | None = None) -> dict:
    """Undo layer after layer until nothing is encoded any more, a payload comes back, or a layer is rejected as a bomb."""
    steps, room = [], MOST_OUTPUT
    data = b"" if data is None else data
    seen = {hash(data)}
    while data and (layers is None or len(steps) < layers):
        step = {"layer": len(steps) + 1, "input_size": len(data), "output_size": len(data), "success": False, "rejected": False}
        try:
            found = _next_layer(data, mode, room)
        except Bomb:
            steps.append({**step, "encoding": "gzip" if data[:2] == b"\x1f\x8b" else "deflate", "rejected": True})
            break
        if found is None:
            break
        encoding, out = found
        good = out is not None and out != data
        steps.append({**step, "encoding": encoding, "output_size": len(out if good else data), "success": out is not None})
        if not good:
            break
        data, room = out, room - len(out)
        if hash(data) in seen:      # a payload that unfolds to itself
            break
        seen.add(hash(data))
    return {"data": data, "steps": steps}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"data": [r["data"] for r in rows], "steps": [r["steps"] for r in rows]})


def _once(fn):
    """An Arrow function whose result is computed once and not inlined into every use."""
    return F.pandas_udf(fn, DECODED).asNondeterministic()


@_once
def _peel_detect(payload: pd.Series) -> pd.DataFrame:
    return _frame([_peel(p, "detect") for p in payload])


@_once
def _peel_attempt(payload: pd.Series) -> pd.DataFrame:
    return _frame([_peel(p, "attempt") for p in payload])


def _line_end(data: bytes, at: int) -> tuple[int, int] | None:
    """End of the line that starts at ``at`` and start of the next one."""
    end = data.find(b"\n", at)
    if end < 0:
        return None
    return (end - 1 if end > at and data[end - 1] == 13 else end), end + 1


def dechunk(data: bytes) -> tuple[bytes, bool]:
    """The chunks that are there whole, and whether the closing chunk and the empty line after its trailer were reached."""
    out, at = bytearray(), 0
    while (line := _line_end(data, at)) is not None:
        try:
            size = int(data[at:line[0]].split(b";")[0].strip(), 16)
        except ValueError:
            break
        at = line[1]
        if size == 0:
            while (line := _line_end(data, at)) is not None:
                if line[0] == at:
                    return bytes(out), True
                at = line[1]
            break
        if size < 0 or at + size > len(data):
            break
        out += data[at:at + size]
        at += size
        at += 2 if data[at:at + 2] == b"\r\n" else 1 if data[at:at + 1] == b"\n" else 0
    return bytes(out), False


def _body(fn):
    return F.pandas_udf(fn, BODY).asNondeterministic()


@_body
def decode_body(body: pd.Series, chunked: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    """Transfer encoding, then the declared content encoding, then whatever layers remain."""
    rows = []
    for data, is_chunked, name in zip(body, chunked, encoding):
        data, steps, ended = b"" if data is None else data, [], False

        def done(kind, before, after, good=True, rejected=False):
            steps.append({"layer": len(steps) + 1, "encoding": kind, "input_size": len(before), "output_size": len(after), "success": good, "rejected": rejected})
        if is_chunked:
            plain, ended = dechunk(data)
            done("chunked", data, plain)
            data = plain
        if name in _UNDO and data:
            try:
                plain, bomb = _UNDO[name](data), False
            except Bomb:
                plain, bomb = None, True
            done(name, data, data if plain is None else plain, plain is not None, bomb)
            data = data if plain is None else plain
        rest = _peel(data, "detect") if not (steps and steps[-1]["rejected"]) else {"data": data, "steps": []}
        for step in rest["steps"]:
            steps.append({**step, "layer": len(steps) + 1})
        rows.append({"data": rest["data"], "steps": steps, "ended": ended})
    return _frame(rows).assign(ended=[r["ended"] for r in rows])


def _may_decode(payload: Column) -> Column:
    """Rows that carry no known encoding are settled without Python."""
    text = F.decode(payload, "ISO-8859-1")
    magic = F.hex(F.substring(payload, 1, 2)).isin("1F8B", "7801", "785E", "789C", "78DA")
    return magic | text.rlike(r"%[^%]*%[^%]*%[^%]*%|^[^%]{0,60}%[0-9a-fA-F]{2}") | text.rlike(r"^[\s\\0-9A-Za-z+/=_-]{20,}$")


def decode_layers(payload: Column, mode: str = "detect") -> Column:
    """Struct of the innermost bytes and the steps that led there.

    ``detect`` names the encoding first and then undoes it; ``attempt`` tries the
    decoders in order and keeps the first that changes anything.
    """
    udf = _peel_detect if mode == "detect" else _peel_attempt
    candidate = _may_decode(payload)
    found = udf(F.when(candidate, payload))
    return F.when(candidate, found).otherwise(F.struct(payload.alias("data"), F.array().cast(STEPS).alias("steps")))
