"""Keyed, time-ordered building blocks that never send one key to one task.

Every detector asks for something "per key, in time order". A plain
``Window.partitionBy(key)`` hands a hot key (a scanner, a gateway) to a single
task. The blocks here cut the time axis of each key into slices and partition
by ``(key, slice)``:

* ``rolling``  - counts, sums and distinct counts over the last L microseconds.
  A row that still matters in the next slice is copied there, and the measure
  is a running sum of +x at entry and -x at expiry, so cost is O(n log n)
  whatever the window holds.
* ``running``  - prefix sums, running maxima, previous and last values over the
  whole history of a key. One small row per (key, slice) is folded along the
  key and joined back as the slice's starting value.

All blocks order by ``(ts, seq)``: a row sees exactly the rows processed before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.session import stage

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def seconds(value: float) -> int:
    return int(round(value * 1_000_000))


def slice_of(ts: Column, width: int) -> Column:
    """Index of the slice a timestamp falls in (floor division, exact for micros)."""
    return ((ts - F.pmod(ts, F.lit(width))) / F.lit(width)).cast("long")


def spread(df: DataFrame, ts: str, lookahead: int | Column, width: int) -> DataFrame:
    """Assign rows to their slice and copy them to the slices they can still affect."""
    own = slice_of(F.col(ts), width)
    last = slice_of(F.col(ts) + (lookahead if isinstance(lookahead, Column) else F.lit(lookahead)), width)
    return df.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(own, last)))


def rolling(df: DataFrame, keys: list[str], window_us: int | Column, measures: dict[str, tuple], *,
            ts: str = "ts_us", seq: str = "seq", closed: bool = False, width: int | None = None) -> DataFrame:
    """Add sliding-window measures over ``(t - window, t]`` (``[t - window, t]`` if closed).

    ``measures`` maps a column name to ``("count", condition | None)``,
    ``("sum", column)`` or ``("distinct", column, condition | None)``. The window may be a
    column that is constant within a key; ``width`` is then required.
    """
    width = width or max(4 * window_us, 10 * MINUTE)
    window_us = window_us if isinstance(window_us, Column) else F.lit(window_us)
    columns = df.columns
    part = [*keys, "_slice"]
    rows = spread(df, ts, window_us, width)
    distinct = {n: m for n, m in measures.items() if m[0] == "distinct"}
    if distinct:
        # one exchange serves the per-item windows and the running sum below
        rows = rows.repartition(*part)
    entry, expiry = {}, {}
    for name, measure in measures.items():
        if measure[0] == "count":
            one = F.lit(1) if measure[1] is None else F.when(measure[1], 1).otherwise(0)
            entry[name], expiry[name] = one.cast("long"), -one.cast("long")
        elif measure[0] == "sum":
            entry[name], expiry[name] = measure[1], -measure[1]
        else:
            # an item is present from an occurrence with no live predecessor until the
            # last occurrence before a silence of a full window expires
            cond = F.lit(True) if len(measure) < 3 or measure[2] is None else F.coalesce(measure[2], F.lit(False))
            rows = rows.withColumn(f"_i_{name}", F.when(cond, measure[1])).withColumn(f"_ok_{name}", cond)
            w = Window.partitionBy(*part, f"_ok_{name}", f"_i_{name}").orderBy(ts, seq)
            before, after = F.lag(ts).over(w), F.lead(ts).over(w)
            expired = (lambda gap: gap > window_us) if closed else (lambda gap: gap >= window_us)
            rows = (rows.withColumn(f"_in_{name}", before.isNull() | expired(F.col(ts) - before))
                        .withColumn(f"_out_{name}", after.isNull() | expired(after - F.col(ts))))
            live = F.col(f"_ok_{name}")
            entry[name] = F.when(live & F.col(f"_in_{name}"), 1).otherwise(0).cast("long")
            expiry[name] = F.when(live & F.col(f"_out_{name}"), -1).otherwise(0).cast("long")
    enter = F.struct(F.col(ts).alias("at"), F.lit(1).alias("phase"), F.struct(*columns).alias("row"),
                     *[entry[n].alias(f"d_{n}") for n in measures])
    leave = F.struct((F.col(ts) + window_us).alias("at"), F.lit(2 if closed else 0).alias("phase"),
                     F.lit(None).cast(df.schema).alias("row"),
                     *[expiry[n].alias(f"d_{n}") for n in measures])
    moves = rows.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_slice", F.col("_own").alias("_own"), F.col(seq).alias("_seq"),
        F.explode(F.when(F.col(ts) + window_us < (F.col("_slice") + 1) * F.lit(width), F.array(enter, leave))
                  .otherwise(F.array(enter))).alias("_m"))
    w = (Window.partitionBy(*[f"_k_{k}" for k in keys], "_slice").orderBy("_m.at", "_m.phase", "_seq")
         .rowsBetween(Window.unboundedPreceding, 0))
    out = moves.select("_slice", "_own", "_m.row", *[F.sum(f"_m.d_{n}").over(w).alias(n) for n in measures])
    return out.where(F.col("row").isNotNull() & (F.col("_slice") == F.col("_own"))).select("row.*", *measures)


def running(df: DataFrame, keys: list[str], measures: dict[str, tuple], *, ts: str = "ts_us", seq: str = "seq",
            width: int = HOUR) -> DataFrame:
    """Add measures over the whole history of a key, in ``(ts, seq)`` order.

    ``("sum", col)`` and ``("max", col)`` include the row itself, ``("past_max", col)``
    does not, ``("prev", col)`` is the value of the row before, ``("last", col)`` the last non-null value up to and
    including the row, ``("before", col)`` the same excluding the row.
    """
    part = [*keys, "_slice"]
    rows = df.withColumn("_slice", slice_of(F.col(ts), width))
    position = F.struct(ts, seq)
    heads, folds = [], []
    along = Window.partitionBy(*keys).orderBy("_slice")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, col) in measures.items():
        c = f"_c_{name}"
        if kind == "sum":
            heads.append(F.sum(col).alias(c))
            folds.append(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c))
        elif kind in ("max", "past_max"):
            heads.append(F.max(col).alias(c))
            folds.append(F.max(c).over(earlier).alias(c))
        elif kind == "prev":
            heads.append(F.max(F.struct(ts, seq, col.alias("v"))).getField("v").alias(c))
            folds.append(F.lag(c).over(along).alias(c))
        else:
            heads.append(F.max(F.when(col.isNotNull(), F.struct(ts, seq, col.alias("v")))).getField("v").alias(c))
            folds.append(F.last(c, ignorenulls=True).over(earlier).alias(c))
    carry = rows.groupBy(*part).agg(*heads).select(*part, *folds)
    local = Window.partitionBy(*part).orderBy(ts, seq)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for name, (kind, col) in measures.items():
        start = F.col(f"_c_{name}")
        if kind == "sum":
            out.append((start + F.sum(col).over(upto)).alias(name))
        elif kind == "max":
            out.append(F.greatest(start, F.max(col).over(upto)).alias(name))
        elif kind == "past_max":
            past = local.rowsBetween(Window.unboundedPreceding, -1)
            out.append(F.greatest(start, F.max(col).over(past)).alias(name))
        elif kind == "prev":
            out.append(F.when(F.row_number().over(local) == 1, start).otherwise(F.lag(col).over(local)).alias(name))
        elif kind == "last":
            out.append(F.coalesce(F.last(col, ignorenulls=True).over(upto), start).alias(name))
        else:
            past = local.rowsBetween(Window.unboundedPreceding, -1)
            out.append(F.coalesce(F.last(col, ignorenulls=True).over(past), start).alias(name))
    return rows.join(carry, part, "left").select(*df.columns, *out)


def numbered(df: DataFrame, keys: list[str], name: str = "rn", **order) -> DataFrame:
    """1-based position of each row in its key."""
    return running(df, keys, {name: ("sum", F.lit(1).cast("long"))}, **order)


def first_rows(df: DataFrame, keys: list[str], order: list, k: int = 1, name: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes each map partition to ``k`` rows per key first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def running_distinct(df: DataFrame, keys: list[str], item: str, name: str, *, ts: str = "ts_us", seq: str = "seq",
                     width: int = HOUR) -> DataFrame:
    """Number of distinct items a key has shown so far, the row included."""
    first = df.groupBy(*keys, item).agg(F.min(F.struct(ts, seq)).alias("_first"))
    flagged = df.join(first, [*keys, item], "left").withColumn(
        "_new", (F.col("_first") == F.struct(ts, seq)).cast("long"))
    return running(flagged, keys, {name: ("sum", F.col("_new"))}, ts=ts, seq=seq, width=width).select(
        *df.columns, name)


def _cut_points(rows: DataFrame, keys: list[str], cuts: int) -> DataFrame:
    """Per key the values that cut its rows into about ``cuts * cuts`` equal parts, from a mergeable sketch."""
    shares = [k / (cuts * cuts) for k in range(1, cuts * cuts)]
    return rows.groupBy(*keys).agg(F.percentile_approx("_v", shares, 20 * cuts * cuts).alias("_cuts"))


def _part_of(cuts: int) -> Column:
    """Number of cut points below the value: first among every ``cuts``-th of them, then among the ones between."""
    points, below = F.col("_cuts"), (lambda x: x < F.col("_v"))
    coarse = F.size(F.filter(F.filter(points, lambda x, i: (i + 1) % cuts == 0), below))
    return coarse * cuts + F.size(F.filter(F.slice(points, coarse * cuts + 1, cuts), below))


def median_by(df: DataFrame, keys: list[str], value: str, name: str = "median", small: int = 100_000, cuts: int = 16) -> DataFrame:
    """Exact median per key (mean of the two middle values), without sorting a large key in one task.

    Equal values are counted first. A key with more than ``small`` distinct values is cut at sampled ranks, so that far values do
    not matter, and only the parts that hold its middle ranks stay, until no key has more than ``small`` (at least as many as
    there are parts, so that every cut leaves fewer).
    """
    small = max(small, cuts * cuts)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    rows = stage(counts).withColumn("_before", F.lit(0).cast("long"))      # already reduced; read several times
    totals = rows.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    while True:
        large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > small).drop("_size")
        if large.isEmpty():
            break
        placed = stage(rows.join(_cut_points(rows.join(large, keys, "left_semi"), keys, cuts), keys, "left")
                       .withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(_part_of(cuts))).drop("_cuts"))
        heads = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_c"), F.min("_before").alias("_from"))
        along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        heads = heads.withColumn("_start", F.col("_from") + F.coalesce(F.sum("_c").over(along), F.lit(0))).join(totals, keys)
        middle = heads.where((F.col("_start") < high) & (F.col("_start") + F.col("_c") >= low))
        first = middle.groupBy(*keys).agg(F.min("_start").alias("_start"))
        rows = stage(placed.join(middle.select(*keys, "_part"), [*keys, "_part"], "left_semi").join(first, keys)
                     .select(*keys, "_v", "_n", F.col("_start").alias("_before")))
    local = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_to", F.col("_before") + F.sum("_n").over(local)).join(totals, keys)

    def at(rank):
        return F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col("_n") < rank), F.col("_v")))
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))
