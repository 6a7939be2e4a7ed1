"""Repeatable samples and previews chosen by hashed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.operators.ordered import first_n, ranked
from hourspark.session import cut


def hash_rank(key: Column) -> Column:
    """First 64 bits of SHA-256 as hex text; text order equals numeric order."""
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows with the lowest hashed key; each task keeps ``n`` rows at most."""
    return df.withColumn("_h", hash_rank(key)).withColumn("_k", key).orderBy("_h", "_k").limit(n).drop("_h", "_k")


def seeded_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of ``n`` rows under ``seed``."""
    return hash_sample(df, F.concat(F.lit(f"{seed}|"), key.cast("string")), n)


def preview(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(*order).limit(n)


def _shaved(df: DataFrame, value: Column, floor: int, amount: int, keys: list[str]) -> DataFrame:
    """Adds ``_cut``: how much of each row's ``value`` goes when ``amount`` units are taken off one by one.

    Each unit comes off the largest value above ``floor``, the first key among equals.  So all values end at a
    common level, and the first keys at that level lose one unit more.  The level follows from the sums over the
    largest values, of which there are few distinct ones; only two scalars leave the cluster.
    """
    held = df.withColumn("_v", value)
    sizes = held.filter(F.col("_v") > floor).groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = F.ceil((F.sum(F.col("_v") * F.col("n")).over(down) - amount) / F.sum("n").over(down))
    level = max(floor, sizes.select(needed.alias("l")).agg(F.max("l")).first()[0] or floor)
    over = F.greatest(F.col("_v") - level, F.lit(0))
    left = amount - (held.agg(F.sum(over)).first()[0] or 0)
    if not left or level <= floor:
        return held.withColumn("_cut", over).drop("_v")
    tied = ranked(held.filter(F.col("_v") >= level).select(*keys), [], keys, "_at").filter(F.col("_at") < left)
    return held.withColumn("_over", over).alias("h").join(tied.alias("t"), [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys], "left").select(
        *[F.col(f"h.{c}") for c in df.columns], (F.col("_over") + F.col("_at").isNotNull().cast("int")).alias("_cut"),
    )


def quotas(counts: DataFrame, strata: list[str], count: str, rows: int) -> DataFrame:
    """Adds ``quota`` to stratum counts: rounded proportional shares of at least one that sum to ``rows``.

    Too many come off the largest shares, missing ones go where most rows are left, one by one.
    """
    total = counts.agg(F.sum(count)).first()[0] or 0
    share = F.greatest(F.lit(1), F.rint(F.col(count) / F.lit(total or 1) * rows).cast("bigint"))
    first = cut(counts.withColumn("quota", share))
    given = first.agg(F.sum("quota")).first()[0] or 0
    if given > rows:
        return _shaved(first, F.col("quota"), 1, given - rows, strata).withColumn("quota", F.col("quota") - F.col("_cut")).drop("_cut")
    return _shaved(first, F.col(count) - F.col("quota"), 0, rows - given, strata).withColumn("quota", F.col("quota") + F.col("_cut")).drop("_cut")


def stratified_preview(df: DataFrame, strata: list[str], key: Column, rows: int, order: list[str]) -> DataFrame:
    """Stable preview of ``rows`` rows, each stratum present, rows taken in hashed-key order."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    shares = cut(quotas(counts, strata, "_n", rows))
    most, total = shares.agg(F.max("quota"), F.sum("_n")).first()
    if (total or 0) <= rows:
        return df.orderBy(*order)
    hashed = df.withColumn("_h", F.sha2(key.cast("binary"), 256)).withColumn("_k", key)
    short = first_n(hashed, strata, [F.col("_h"), F.col("_k")], most, "_rn")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in strata]
    kept = short.alias("s").join(shares.alias("q"), on).filter("_rn <= quota")
    return kept.select(*[F.col(f"s.{c}") for c in df.columns]).orderBy(*order).limit(rows)
