"""Text and byte functions as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def shannon_entropy(payload: pd.Series) -> pd.Series:
    """Entropy of the byte distribution in bits, 0 for empty or null; whole Arrow batches at a time."""
    def one(data) -> float:
        if not data:
            return 0.0
        counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        share = counts[counts > 0] / len(data)
        return float(-(share * np.log2(share)).sum())
    return payload.map(one).astype("float64")


def url_decode(text: Column) -> Column:
    """Percent-decode ('+' is a space); a '%' that starts no escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")), text)


def url_decode2(text: Column) -> Column:
    """Decode twice, for double-encoded payloads."""
    return url_decode(url_decode(text))


def latin1(payload: Column) -> Column:
    """Bytes as text, one character per byte."""
    return F.decode(payload, "ISO-8859-1")


def utf8(payload: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(payload.cast("string"))


def sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)
