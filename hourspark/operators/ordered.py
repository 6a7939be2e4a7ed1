"""Ordered operators that never put one key's whole history into one task.

A window partitioned by a key alone sends a hot key to a single task.  Here every key is cut
into slices of the order column (a slice is ``floor(order / width)``): the slice is part of the
shuffle key, so a key that holds a third of all rows is spread over as many tasks as it has
slices.  What crosses a slice border is either a small per-slice summary (``running``) or a
copied overlap of the bounded look-back (``past_windows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.functions.timestamps import MICROS_PER_HOUR, epoch_micros
from hourspark.session import cut

DAY_MICROS = 24 * MICROS_PER_HOUR
# Hourly rows are unique per unit, so a slice of 28 days holds at most 672 of them.
HISTORY_SLICE_HOURS = 28 * 24


def slice_of(order: Column, width: int) -> Column:
    """Slice number of a long order value."""
    return F.floor(order / F.lit(width)).cast("bigint")


def suggest_width(df: DataFrame, order: Column, rows_per_slice: int = 1_000_000) -> int:
    """Slice width so that an average slice over all keys holds ``rows_per_slice`` rows."""
    facts = df.agg(F.count(order).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if not facts.n:
        return 1
    slices = max(1, -(-facts.n // rows_per_slice))
    return max(1, (facts.hi - facts.lo + 1 + slices - 1) // slices)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_col: Column,
    totals: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    overall: dict[str, str] | None = None,
) -> DataFrame:
    """Running totals per key in order; ``totals`` maps a new name to (kind, column).

    Kinds: ``sum``, ``count`` (non-null values), ``min``, ``max`` and ``last`` (latest non-null
    value).  ``inclusive=False`` leaves out the current row.  ``overall`` maps a new name to a sum or
    count whose total over the whole key is wanted on every row.  ``slice_col`` must not decrease
    along ``order``.  The per-slice summaries are aggregated map-side and are the only rows that
    meet per key; they read ``df`` a second time, so a costly ``df`` is better written first
    (``session.cut``).
    """
    part = [*keys, "_slice"]
    cut = df.withColumn("_slice", slice_col).withColumns({f"_v_{n}": c for n, (_, c) in totals.items()})
    ordering = F.struct(*order)

    def within(kind: str, col: Column) -> Column:
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](col)

    here = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = {
        f"_l_{n}": F.last(F.col(f"_v_{n}"), ignorenulls=True).over(here)
        if kind == "last" else within(kind, F.col(f"_v_{n}")).over(here)
        for n, (kind, _) in totals.items()
    }
    summary = cut.groupBy(*part).agg(*[
        (
            F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), ordering))
            if kind == "last" else within(kind, F.col(f"_v_{n}"))
        ).alias(f"_s_{n}")
        for n, (kind, _) in totals.items()
    ])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*part, *[
        (
            F.last(F.col(f"_s_{n}"), ignorenulls=True) if kind == "last"
            else F.sum(F.col(f"_s_{n}")) if kind in ("sum", "count")
            else within(kind, F.col(f"_s_{n}"))
        ).over(before).alias(f"_b_{n}")
        for n, (kind, _) in totals.items()
    ], *[F.sum(F.col(f"_s_{of}")).over(Window.partitionBy(*keys)).alias(n) for n, of in (overall or {}).items()])

    def combined(name: str, kind: str) -> Column:
        mine, past = F.col(f"_l_{name}"), F.col(f"_b_{name}")
        if kind in ("sum", "count"):
            both = F.coalesce(mine, F.lit(0)) + F.coalesce(past, F.lit(0))
            return both if kind == "count" else F.when(mine.isNotNull() | past.isNotNull(), both)
        if kind == "last":
            return F.coalesce(mine, past)
        return (F.least if kind == "min" else F.greatest)(mine, past)

    joined = cut.withColumns(local).alias("c").join(
        carried.alias("b"), [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in part], "left"
    )
    return joined.select(
        *[F.col(f"c.{c}") for c in df.columns],
        *[combined(n, kind).alias(n) for n, (kind, _) in totals.items()],
        *[F.col(f"b.{n}") for n in (overall or {})],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], slice_col: Column, name: str = "rn") -> DataFrame:
    """Exact 1-based row number per key (over all rows with ``keys=[]``)."""
    return running(df, keys, order, slice_col, {name: ("count", F.lit(1))})


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], slice_col: Column, columns: list[str], name: str = "prev"
) -> DataFrame:
    """Struct of the previous row's ``columns`` per key; null on a key's first row."""
    held = F.struct(*columns)
    return running(df, keys, order, slice_col, {name: ("last", held)}, inclusive=False)


def past_windows(
    df: DataFrame,
    keys: list[str],
    instant: str,
    value: str,
    lags: tuple[int, ...] = (1, 24, 168),
    means: tuple[int, ...] = (24, 168),
    deviations: tuple[int, ...] = (24, 168),
    counts: tuple[int, ...] = (24, 168),
    null_when_empty: bool = True,
    prefix: str | None = None,
    slice_hours: int = HISTORY_SLICE_HOURS,
    deviation: str = "sample",
) -> DataFrame:
    """Exact-time lags and strictly past rolling statistics of ``value``, in hours.

    A lag is the value exactly k hours earlier, null over a gap.  A rolling window is
    [t - k h, t) and never contains the row itself.  One shuffle and one sort serve all columns;
    the last ``max(k)`` hours of a slice are copied into the next slice as look-back.
    """
    prefix = prefix or value
    reach = max([*lags, *means, *deviations, *counts])
    width = max(slice_hours, reach) * MICROS_PER_HOUR
    micros = epoch_micros(F.col(instant))
    number = slice_of(F.col("_us"), width)
    near_end = F.pmod(F.col("_us"), F.lit(width)) >= width - reach * MICROS_PER_HOUR
    own = F.struct(number.alias("n"), F.lit(False).alias("copied"))
    following = F.struct((number + 1).alias("n"), F.lit(True).alias("copied"))
    spread = df.withColumn("_us", micros).withColumn(
        "_slice", F.explode(F.when(near_end, F.array(own, following)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*keys, F.col("_slice.n")).orderBy("_us")

    def exactly(k: int) -> Column:
        return F.max(value).over(w.rangeBetween(-k * MICROS_PER_HOUR, -k * MICROS_PER_HOUR))

    def past(k: int):  # type: ignore[no-untyped-def]
        return w.rangeBetween(-k * MICROS_PER_HOUR, -1)

    spread_of = F.stddev_samp if deviation == "sample" else F.stddev_pop
    new: dict[str, Column] = {f"{prefix}_lag_{k}h": exactly(k) for k in lags}
    new |= {f"{prefix}_rolling_past_{k}h_mean": F.avg(value).over(past(k)) for k in means}
    new |= {f"{prefix}_rolling_past_{k}h_stddev": spread_of(value).over(past(k)) for k in deviations}
    for k in counts:
        n = F.count(value).over(past(k))
        new[f"{prefix}_rolling_past_{k}h_count"] = F.nullif(n, F.lit(0)) if null_when_empty else n
    new = {name: column.alias(name, metadata={"asof": "past"}) for name, column in new.items()}
    return spread.withColumns(new).filter(~F.col("_slice.copied")).drop("_us", "_slice")


def shifted_lags(df: DataFrame, keys: list[str], instant: str, value: str, lags: tuple[int, ...] = (1, 24, 168)) -> DataFrame:
    """The same exact-time lags as equi-joins of the table with itself on (key, instant + k h)."""
    out = df
    for k in lags:
        earlier = df.select(
            *keys, (F.col(instant) + F.expr(f"make_dt_interval(0, {k}, 0, 0)")).alias(instant),
            F.col(value).alias(f"{value}_lag_{k}h"),
        )
        out = out.join(earlier, [*keys, instant], "left")
    return out


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key; Spark cuts each map task to ``n`` rows per key before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def rank_value(df: DataFrame, keys: list[str], value: str, share: float, name: str, width: float) -> DataFrame:
    """Per key the element at 0-based rank ``floor(share * n)`` (the last one at most).

    Equal values are counted first, so only the histogram is ordered; ``width`` is the value range
    of one slice.
    """
    cumulated = cumulated_counts(df, keys, value, width)
    wanted = F.least(F.col("_size"), F.floor(F.lit(float(share)) * F.col("_size")) + 1)
    return cumulated.filter(F.col("_cum") >= wanted).groupBy(*keys).agg(F.min(value).alias(name))


def cumulated_counts(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Distinct values per key with ``_n`` rows, ``_cum`` rows at or below and ``_size`` rows in all."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return running(
        counts, keys, [value], F.floor(F.col(value) / F.lit(width)), {"_cum": ("sum", F.col("_n"))}, overall={"_size": "_cum"}
    )


def cumulative_share(df: DataFrame, keys: list[str], value: str, width: float, name: str = "share") -> DataFrame:
    """Empirical distribution per key: distinct values with the share of rows at or below each."""
    return cumulated_counts(df, keys, value, width).select(*keys, value, (F.col("_cum") / F.col("_size")).alias(name))


def shifted(df: DataFrame, keys: list[str], seq: str, columns: list[str], offsets: dict[str, int]) -> DataFrame:
    """Structs of ``columns`` of the rows ``offset`` places away in a dense integer sequence, by name.

    Every row is sent to the places that ask for it and one aggregation per (key, place) gathers them, so
    there is one shuffle and no key is ever one task.
    """
    held = F.struct(*columns)
    cells = F.array(*[F.struct(F.lit(n).alias("n"), (F.col(seq) - o).alias("at")) for n, o in {"here": 0, **offsets}.items()])
    sent = df.select(*keys, held.alias("_v"), F.explode(cells).alias("_c")).select(*keys, "_v", F.col("_c.at").alias(seq), "_c.n")
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("_v")))
    met = sent.groupBy(*keys, seq).agg(pick("here").alias("here"), *[pick(n).alias(n) for n in offsets])
    return met.filter(F.col("here").isNotNull())


def step_lookup(reference: DataFrame, queries: DataFrame, keys: list[str], at: str, value: str, width: float) -> DataFrame:
    """As-of lookup: for each query row the ``value`` of the last reference row with ``at`` not above its own.

    ``reference`` holds (keys, at, value); no range join is planned, both sides are laid on one axis.
    """
    extra = [c for c in queries.columns if c not in (*keys, at)]
    marks = reference.select(
        *keys, at, F.lit(0).alias("_asks"), F.struct(F.col(value).alias("v")).alias("_mark"),
        F.lit(None).cast(queries.select(F.struct(*extra)).schema[0].dataType).alias("_row") if extra else F.lit(None).cast("int").alias("_row"),
    )
    asks = queries.select(
        *keys, at, F.lit(1).alias("_asks"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"),
        F.struct(*extra).alias("_row") if extra else F.lit(None).cast("int").alias("_row"),
    )
    axis = marks.unionByName(asks)
    found = running(axis, keys, [at, "_asks"], F.floor(F.col(at) / F.lit(width)), {"_found": ("last", F.col("_mark"))})
    return found.filter(F.col("_asks") == 1).select(
        *keys, at, *[F.col(f"_row.{c}").alias(c) for c in extra], F.col("_found.v").alias(value)
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Position from 0 of each row among its key's rows in ``order``, for any kind of column.

    Rows are range-sorted once and written with their range; a position is the number of the key's rows in
    earlier ranges plus the row number within the range.  No slice width is needed and no key stays whole.
    """
    laid = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = laid.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    placed = laid.withColumn("_within", within).alias("l").join(before.alias("b"), [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_range"]])
    return placed.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_before") + F.col("_within")).alias(name))
