"""Data contracts: fail-closed expectations, key checks, coverage and leakage guards."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourspark.functions.timestamps import epoch_micros, floor_hour, from_epoch_micros, utc_to_local
from hourspark.session import cut


class ContractError(ValueError):
    """A table broke its contract."""


@dataclass(frozen=True)
class Expectation:
    """``violated`` is true on a row that breaks the rule; null counts as kept."""

    name: str
    violated: Column


def require_columns(df: DataFrame, names: list[str], label: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{label} lacks columns {missing}")
    return df


def violations(df: DataFrame, rules: list[Expectation], by: list[str] | None = None) -> DataFrame:
    """One row of violation counts (per ``by``): every rule is counted in the same pass."""
    counts = [F.count_if(r.violated).alias(r.name) for r in rules]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *counts)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key groups with more than one row; copies collapse map-side."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def report(df: DataFrame, rules: list[Expectation], key: list[str] | None = None) -> DataFrame:
    """(name, violations) for all rules, plus the duplicate groups of ``key``."""
    counted = violations(df, rules)
    names = ["rows", *[r.name for r in rules]]
    long = counted.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("violations")) for n in names
    ])).alias("r")).select("r.*")
    if key:
        groups = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("violations"))
        long = long.unionByName(groups.select(F.lit("duplicate_key_groups").alias("name"), "violations"))
    return long


def enforce(df: DataFrame, rules: list[Expectation], key: list[str] | None = None, allow_empty: bool = False) -> DataFrame:
    """Return ``df`` unchanged, or fail with every broken rule and its count."""
    found = {r.name: r.violations for r in report(df, rules, key).collect()}
    rows = found.pop("rows")
    broken = {name: n for name, n in found.items() if n}
    if broken or (rows == 0 and not allow_empty):
        raise ContractError(f"rows={rows}, violations={broken}")
    return df


def hourly_target_rules(key: list[str], instant: str, target: str) -> list[Expectation]:
    """Rules of every canonical hourly table."""
    null_key = F.lit(False)
    for name in key:
        null_key = null_key | F.col(name).isNull()
    value = F.col(target)
    return [
        Expectation("null_key_rows", null_key),
        Expectation("invalid_target_rows", value.isNull() | (value < 0) | (value != F.floor(value))),
        Expectation("non_hourly_rows", floor_hour(F.col(instant)) != F.col(instant)),
    ]


def zone_rules(utc: str, local: str, local_date: str, local_hour: str, zone: str) -> list[Expectation]:
    """Stored local fields must equal the ones recomputed from the instant."""
    again = utc_to_local(F.col(utc), zone)
    return [
        Expectation("local_timestamp_mismatch", ~F.col(local).eqNullSafe(again)),
        Expectation("local_date_mismatch", ~F.col(local_date).eqNullSafe(F.to_date(again))),
        Expectation("local_hour_mismatch", ~F.col(local_hour).cast("int").eqNullSafe(F.hour(again))),
    ]


def as_of_rule(target: str, as_of: str, hours: int = 1) -> Expectation:
    """Features may know nothing newer than ``hours`` before the target."""
    gap = epoch_micros(F.col(target)) - epoch_micros(F.col(as_of))
    return Expectation("as_of_mismatch", ~gap.eqNullSafe(F.lit(hours * 3_600_000_000)))


def canonical_value_rules(columns: list[str]) -> list[Expectation]:
    """Raw values must already be trimmed lower case, so that equality filters reach the scan."""
    return [Expectation(f"{c}_not_canonical", F.col(c) != F.lower(F.trim(F.col(c)))) for c in columns]


def key_alignment(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Counts of keys on both sides, on the left only and on the right only."""
    both = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = both.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared_keys"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only_keys"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only_keys"),
    )


def require_same_keys(left: DataFrame, right: DataFrame, key: list[str]) -> None:
    """Both tables must hold the same distinct keys, each exactly once."""
    facts = key_alignment(left, right, key).first().asDict()
    rows = (left.count(), right.count())
    if facts["left_only_keys"] or facts["right_only_keys"] or set(rows) != {facts["shared_keys"]}:
        raise ContractError(f"keys differ: {facts}, rows={rows}")


def mismatches(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Shared keys whose ``columns`` differ, null-safe."""
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), key).filter(differs).select(
        *key, *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in columns for s, n in (("l", "left"), ("r", "right"))]
    )


def date_spine(bounds: DataFrame, first: str, last: str, name: str = "day") -> DataFrame:
    """All dates from ``first`` to ``last`` of every row of ``bounds``."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias(name)).distinct()


def coverage_gaps(expected: DataFrame, observed: DataFrame, allowed: DataFrame | None, day: str = "day") -> DataFrame:
    """Expected dates that were not observed, each with whether the allow-list covers it."""
    missing = expected.select(day).distinct().join(observed.select(day).distinct(), day, "left_anti")
    if allowed is None:
        return missing.withColumn("allowed", F.lit(False))
    listed = allowed.select(day).distinct().withColumn("_listed", F.lit(True))
    return missing.join(listed, day, "left").select(day, F.coalesce("_listed", F.lit(False)).alias("allowed"))


def coverage_report(
    expected: DataFrame, observed: DataFrame, allowed: DataFrame, expected_sources: DataFrame,
    observed_sources: DataFrame, day: str = "day", source: str = "source",
) -> DataFrame:
    """One row: missing sources, missing dates split by the allow-list, missing years, partial flag.

    A whole missing year is excused only when every expected date of that year is allowed.
    """
    gaps = coverage_gaps(expected, observed, allowed, day)
    dates = gaps.agg(
        F.count(F.lit(1)).alias("missing_dates"),
        F.count_if("allowed").alias("allowed_missing_dates"),
        F.count_if(~F.col("allowed")).alias("unexpected_missing_dates"),
    )
    years = expected.select(F.year(day).alias("y"), day).distinct().join(
        gaps.select(day, F.lit(1).alias("gap"), "allowed"), day, "left"
    ).groupBy("y").agg(
        F.count_if(F.col("gap").isNull()).alias("seen"), F.count_if(~F.coalesce("allowed", F.lit(False))).alias("needed")
    ).filter("seen = 0 and needed > 0").agg(F.count(F.lit(1)).alias("n"))
    sources = expected_sources.select(source).distinct().join(
        observed_sources.select(source).distinct(), source, "left_anti"
    ).agg(F.count(F.lit(1)).alias("n"))
    out = dates.withColumns({"missing_years": years.scalar(), "missing_sources": sources.scalar()})
    return out.withColumn(
        "partial", (F.col("missing_sources") > 0) | (F.col("missing_years") > 0) | (F.col("unexpected_missing_dates") > 0)
    )


def refuse_partial(coverage: DataFrame) -> None:
    """Later steps refuse a table whose coverage report says partial."""
    if coverage.filter("partial").limit(1).count():
        raise ContractError(f"input is partial: {coverage.first().asDict()}")


def hourly_spine_gaps(df: DataFrame, instant: str) -> DataFrame:
    """Hours between the first and the last instant that have no row."""
    bounds = df.agg(F.min(floor_hour(F.col(instant))).alias("lo"), F.max(floor_hour(F.col(instant))).alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    return spine.join(df.select(floor_hour(F.col(instant)).alias("hour")).distinct(), "hour", "left_anti")


def parameter_quality(df: DataFrame, instant: str, parameters: list[str]) -> DataFrame:
    """Per parameter the null count and the newest instant with a value."""
    facts = df.agg(*[
        F.struct(
            F.lit(p).alias("parameter"),
            F.count_if(F.col(p).isNull()).alias("missing_count"),
            F.max(F.when(F.col(p).isNotNull(), F.col(instant))).alias("valid_max"),
        ).alias(p)
        for p in parameters
    ])
    return facts.select(F.explode(F.array(*parameters)).alias("q")).select("q.*")


def partition_inventory(df: DataFrame, source: str, label: str, contract: DataFrame) -> DataFrame:
    """Per file its source and label with the faults: mixed content, or a source outside the contract."""
    files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(source).alias("sources"), F.count_distinct(label).alias("labels"),
        F.min(source).alias(source), F.min(label).alias(label),
    )
    known = contract.select(source, label).distinct().withColumn("_known", F.lit(True))
    return files.join(known, [source, label], "left").select(
        "file", "rows", source, label,
        ((F.col("sources") != 1) | (F.col("labels") != 1)).alias("mixed"),
        F.col("_known").isNull().alias("outside_contract"),
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its order; absent ones become typed nulls."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if got != want:
        raise ContractError(f"schema differs: {sorted(set(got) ^ set(want))}")
    return df


def schema_hash(df: DataFrame) -> str:
    """SHA-256 of the column names and types in order."""
    text = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields], separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def freshness(df: DataFrame, keys: list[str], instant: str, lags: list[str], as_of: Column) -> DataFrame:
    """Readiness per unit: degraded when history stops before ``as_of`` or lag columns are null."""
    newest = latest_with_lags(df, keys, instant, lags)
    stale = F.when(F.col("newest") < as_of, F.lit("stale_lag_history"))
    lacking = [F.when(F.col(c).isNull(), F.lit("missing_lag_history")) for c in lags]
    warnings = F.array_distinct(F.filter(F.array(stale, *lacking), lambda w: w.isNotNull()))
    return newest.withColumn("warnings", warnings).withColumn(
        "status", F.when(F.size("warnings") == 0, "ok").otherwise("degraded")
    )


def latest_with_lags(df: DataFrame, keys: list[str], instant: str, lags: list[str]) -> DataFrame:
    row = F.max_by(F.struct(*lags), F.col(instant)).alias("_row")
    return df.groupBy(*keys).agg(F.max(instant).alias("newest"), row).select(
        *keys, "newest", *[F.col(f"_row.{c}").alias(c) for c in lags]
    )


def score_gaps(scores: DataFrame, candidates: list[str], splits: list[str], group: str = "group_id") -> DataFrame:
    """(candidate, group, split) combinations that are absent or present more than once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(s).alias("split")) for c in candidates for s in splits])
    spine = scores.select(group).distinct().withColumn("p", F.explode(pairs)).select(group, "p.candidate", "p.split")
    seen = scores.groupBy(group, "candidate", "split").agg(F.count(F.lit(1)).alias("rows"))
    return spine.join(seen, [group, "candidate", "split"], "left").select(
        group, "candidate", "split", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows")
    ).filter("rows <> 1")


# Leakage guard --------------------------------------------------------------------------------

# Columns that identify or label a row and may never be features.
AUDIT_COLUMNS = [
    "observation_key", "split", "local_date", "observed_at_local", "local_timestamp", "hour_start_utc",
    "feature_asof_utc", "feature_asof_local", "label_source", "measurement_scope", "source_dataset_id",
    "source_record_id", "vehicle_count", "log1p_vehicle_count", "intersection_total", "pedestrian_flow",
    "target", "target_count",
]
# What a column's metadata says about when its value is known: before the target hour, or at any time (calendar).
AS_OF = "asof"
PAST, ALWAYS = "past", "always"


def known(column: Column, name: str, when: str = PAST) -> Column:
    """``column`` as ``name``, marked with the time its value is known."""
    return column.alias(name, metadata={AS_OF: when})


def mark_known(df: DataFrame, names: list[str], when: str = PAST) -> DataFrame:
    """Mark columns that were made elsewhere."""
    for name in names:
        df = df.withMetadata(name, {**df.schema[name].metadata, AS_OF: when})
    return df


def leaking_features(df: DataFrame, names: list[str], diagnostics: list[str] = ()) -> list[str]:
    """Names that may not be features: listed ones, and columns of ``df`` that no operator marked as known in time.

    The operators that look back (windows, feeds) and those of the calendar mark what they make; a mark follows a
    column through selections and written tables, and a new expression over it loses the mark.
    """
    banned = {n.lower() for n in [*AUDIT_COLUMNS, *diagnostics]}
    marked = {f.name for f in df.schema if f.metadata.get(AS_OF) in (PAST, ALWAYS)}
    return sorted({n for n in names if n.lower() in banned or n not in marked})


def enforce_features(df: DataFrame, names: list[str], diagnostics: list[str] = ()) -> list[str]:
    """The names themselves, or an error for an empty, repeated or leaking list."""
    if not names or len(set(names)) != len(names):
        raise ContractError("feature list is empty or repeats a column")
    leaks = leaking_features(df, names, diagnostics)
    if leaks:
        raise ContractError(f"features leak the target hour: {leaks}")
    return names


def leaks_on_data(
    build: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str], instant: str, value: str, names: list[str], moments: list[int],
) -> DataFrame:
    """(name, changed): in how many rows a column of ``build(rows)`` depends on values it could not know.

    The table is built again with every value from a moment (epoch microseconds) on replaced.  A row at or before
    the moment then may not differ in any column that is known before its hour, whatever its mark says.  Each
    moment checks the rows at it against their own value and all earlier rows against the future.  ``keys`` and
    ``instant`` name a row.
    """
    base = cut(build(rows).select(*keys, instant, *names))
    counts = None
    for us in moments:
        moment = from_epoch_micros(F.lit(us))
        other = (F.col(value) * 7 + 3).cast(rows.schema[value].dataType)
        changed = rows.withColumn(value, F.when(F.col(instant) >= moment, other).otherwise(F.col(value)))
        after = build(changed).filter(F.col(instant) <= moment).select(*keys, instant, *[F.col(c).alias(f"_{c}") for c in names])
        met = base.join(after, [*keys, instant]).agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in names])
        counts = met if counts is None else counts.unionByName(met)
    summed = counts.agg(*[F.sum(c).alias(c) for c in names])
    return summed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("changed")) for c in names])).alias("c")).select("c.*")


def resolve_role(df: DataFrame, aliases: list[str], role: str, required: bool = True, loose: bool = False) -> str | None:
    """The first alias that is a column of ``df``; ``loose`` compares letters and digits only."""
    plain = lambda name: re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") if loose else name
    have = {plain(c): c for c in df.columns}
    found = next((have[plain(a)] for a in aliases if plain(a) in have), None)
    if found is None and required:
        raise ContractError(f"no column for role {role!r}, tried {aliases}")
    return found


def with_local_date(df: DataFrame, aliases: list[str], name: str = "role_date", stated: str | None = None) -> DataFrame:
    """Adds the date of the time role: the stated column, the first alias present, or year, month and day."""
    found = stated or resolve_role(df, aliases, "time", required=False)
    if found:
        return require_columns(df, [found], "time role").withColumn(name, F.to_date(found))
    require_columns(df, ["year", "month", "day"], "time role")
    return df.withColumn(name, F.make_date("year", "month", "day"))
