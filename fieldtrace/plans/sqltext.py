"""Fragments of the SQL twins."""

from __future__ import annotations


def anchors(source: str, keys: str, gap_us: int, strict: bool = True, ts: str = "ts_us", name: str = "anc") -> str:
    """CTE ``name(keys, mark_us)``: greedy window starts per key, folded over the sorted times."""
    op = ">" if strict else ">="
    return (f"{name} AS (SELECT {keys}, unnest(list_reduce(list_transform(list({ts} ORDER BY {ts}), lambda v: [v]), "
            f"lambda a, x: CASE WHEN x[1] - a[-1] {op} {gap_us} THEN list_concat(a, x) ELSE a END)) AS mark_us "
            f"FROM {source} GROUP BY {keys})")


def windows(source: str, keys: str, ts: str = "ts_us", name: str = "win", anc: str = "anc") -> str:
    """CTE ``name``: each row of ``source`` with the ``mark_us`` of its window."""
    on = " AND ".join(f"s.{k} = a.{k}" for k in keys.split(", "))
    return f"{name} AS (SELECT s.*, a.mark_us FROM {source} s ASOF JOIN {anc} a ON {on} AND s.{ts} >= a.mark_us)"


def kept(source: str, keys: str, gap_us: int, strict: bool = False, ts: str = "ts_us", name: str = "kept") -> str:
    """CTEs ending in ``name``: rows left after a cooldown."""
    return (anchors(source, keys, gap_us, strict, ts, f"{name}_a") + ", "
            + f"{name} AS (SELECT * EXCLUDE (_n) FROM (SELECT s.*, row_number() OVER (PARTITION BY {keys}, {ts} ORDER BY seq) AS _n "
            + f"FROM {source} s SEMI JOIN {name}_a a ON "
            + " AND ".join(f"s.{k} = a.{k}" for k in keys.split(", ")) + f" AND s.{ts} = a.mark_us) WHERE _n = 1)")


ENTROPY = ("(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / CAST(length({x}) AS DOUBLE) AS p "
           "FROM unnest(string_split({x}, '')) u(ch) GROUP BY ch))")

# the same over the bytes of any text
BYTE_ENTROPY = ("(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / CAST(octet_length(encode({x})) AS DOUBLE) AS p "
                "FROM unnest(regexp_extract_all(hex(encode({x})), '..')) u(ch) GROUP BY ch))")
