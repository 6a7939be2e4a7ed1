"""Nested JSON payloads as rows: hourly series, line features, ways and point features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.numbers import sentinel_to_null
from hourspark.operators.ordered import running
from hourspark.operators.quality import ContractError

SERIES_SCHEMA = (
    "struct<header:struct<fill_value:double>,"
    "properties:struct<parameter:map<string,map<string,string>>,parameters:map<string,map<string,string>>>>"
)
# Fixed value: hour stamps as yyyyMMddHH or yyyyMMddHH00.
STAMP = r"^(\d{4})(\d{2})(\d{2})(\d{2})(?:00)?$"
LINE_SCHEMA = "struct<features:array<struct<geometry:struct<type:string,coordinates:array<array<double>>>>>>"
WAY_SCHEMA = (
    "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,"
    "geometry:array<struct<lat:double,lon:double>>>>>"
)
FEATURE_SCHEMA = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"

# Walkable way tags and the access values that close a way.
WALKABLE = [
    "footway", "path", "pedestrian", "steps", "living_street", "residential", "service", "unclassified",
    "tertiary", "secondary", "primary",
]
CLOSED_ACCESS = ["private", "no"]


def series_long(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """(parameter, stamp, value) of hourly map payloads; sentinels and the provider's fill become null."""
    parsed = payloads.select(F.from_json(json, SERIES_SCHEMA).alias("p"))
    maps = parsed.select(
        F.col("p.header.fill_value").alias("fill"),
        F.explode(F.coalesce("p.properties.parameter", "p.properties.parameters")).alias("parameter", "series"),
    )
    return maps.select("fill", "parameter", F.explode("series").alias("key", "text")).select(
        "parameter", "key",
        F.regexp_replace(F.col("key"), STAMP, "$1-$2-$3 $4:00:00").try_cast("timestamp_ntz").alias("stamp"),
        sentinel_to_null(F.col("text"), F.col("fill")).alias("value"),
    )


def hourly_series(
    payloads: DataFrame, parameters: list[str], first: Column, last: Column, fallback: dict[str, str] | None = None, json: str = "payload"
) -> DataFrame:
    """One row per hour of [first, last] with a column per parameter.

    Refuses bad, repeated or outside stamps, a parameter without series, and an hour in no series.
    ``fallback`` names the parameter that stands in for an absent one.
    """
    long = series_long(payloads, json)
    begin, end = first.cast("timestamp_ntz"), F.date_add(last, 1).cast("timestamp_ntz")
    source = {p: (fallback or {}).get(p, p) for p in parameters}
    facts = long.agg(
        F.count_if(F.col("stamp").isNull()).alias("bad_stamps"),
        F.count_if((F.col("stamp") < begin) | (F.col("stamp") >= end)).alias("outside"),
        *[F.count_if(F.col("parameter") == s).alias(f"rows_{s}") for s in sorted(set(source.values()))],
    ).first().asDict()
    repeated = long.groupBy("parameter", "stamp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    absent = [k for k, n in facts.items() if k.startswith("rows_") and n == 0]
    if facts["bad_stamps"] or facts["outside"] or repeated or absent:
        raise ContractError(f"hourly payload refused: {facts}, repeated={bool(repeated)}")
    wide = long.groupBy("stamp").agg(*[
        F.max(F.when(F.col("parameter") == s, F.col("value"))).alias(p) for p, s in source.items()
    ])
    spine = payloads.limit(1).select(F.explode(F.sequence(begin, end - F.expr("interval 1 hour"), F.expr("interval 1 hour"))).alias("stamp"))
    if not spine.join(wide, "stamp", "left_anti").isEmpty():
        raise ContractError("hourly payload misses hours of the requested interval")
    return wide.select("stamp", *parameters).orderBy("stamp")


LINES = ["document", "feature"]


def segments_of(lines: DataFrame, coordinates: str = "coordinates") -> DataFrame:
    """Consecutive coordinate pairs of line strings with the ordinals of both vertices.

    ``lines`` has document and feature, which name a line and order it.  Vertices are numbered through all lines
    in that order, so neither the number of documents nor the length of a line is limited.
    """
    sized = lines.filter(F.size(coordinates) >= 2).select(*LINES, coordinates, F.size(coordinates).cast("bigint").alias("_n"))
    # A slice is a run of features of one document; documents are numbered in steps of 2^24 slices.
    part = F.shiftleft(F.col("document").cast("bigint"), 24) + F.floor(F.col("feature") / F.lit(4_096))
    counted = running(sized.select(*LINES, "_n"), [], LINES, part, {"_upto": ("sum", F.col("_n"))})
    based = sized.join(counted.select(*LINES, (F.col("_upto") - F.col("_n")).alias("_base")), LINES)
    line = F.col(coordinates)
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(line) - 2),
        lambda i: F.struct(
            (F.col("_base") + i).alias("ordinal_a"), F.get(line, i)[0].alias("lon_a"), F.get(line, i)[1].alias("lat_a"),
            (F.col("_base") + i + 1).alias("ordinal_b"), F.get(line, i + 1)[0].alias("lon_b"), F.get(line, i + 1)[1].alias("lat_b"),
        ),
    )
    return based.select(*LINES, F.explode(pairs).alias("s")).select(*LINES, "s.*")


def line_features(documents: DataFrame, json: str = "payload", document: str = "document") -> DataFrame:
    """(document, feature, coordinates) of the line strings of feature collections; ``document`` ranks them."""
    parsed = documents.select(F.col(document).cast("bigint").alias("document"), F.posexplode(F.from_json(json, LINE_SCHEMA)["features"]).alias("pos", "f"))
    return parsed.filter(F.col("f.geometry.type") == "LineString").select(
        "document", F.col("pos").cast("bigint").alias("feature"), F.col("f.geometry.coordinates").alias("coordinates")
    )


def walkable_ways(documents: DataFrame, json: str = "payload", document: str = "document") -> DataFrame:
    """(document, feature, way_id, highway, coordinates) of open walkable ways with two points or more."""
    parsed = documents.select(F.col(document).cast("bigint").alias("document"), F.posexplode(F.from_json(json, WAY_SCHEMA)["elements"]).alias("pos", "e"))
    tag = lambda name: F.try_element_at(F.col("e.tags"), F.lit(name))
    open_way = tag("highway").isin(WALKABLE) & F.coalesce(tag("foot") != "no", F.lit(True)) & F.coalesce(
        ~tag("access").isin(CLOSED_ACCESS), F.lit(True)
    )
    return parsed.filter((F.col("e.type") == "way") & (F.size("e.geometry") >= 2) & open_way).select(
        "document", F.col("pos").cast("bigint").alias("feature"), F.col("e.id").alias("way_id"), tag("highway").alias("highway"),
        F.transform("e.geometry", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"),
    )


def feature_points(documents: DataFrame, json: str = "payload") -> DataFrame:
    """(lon, lat) of point features; polygons by the mean of their first outer ring's vertices."""
    parsed = documents.select(F.explode(F.from_json(json, FEATURE_SCHEMA)["features"]["geometry"]).alias("g"))
    kind, text = F.col("g.type"), F.col("g.coordinates")
    ring = F.when(kind == "Polygon", F.get(F.from_json(text, "array<array<array<double>>>"), F.lit(0))).when(
        kind == "MultiPolygon", F.get(F.get(F.from_json(text, "array<array<array<array<double>>>>"), F.lit(0)), F.lit(0))
    ).when(kind == "Point", F.array(F.from_json(text, "array<double>")))
    mean = lambda i: F.aggregate(F.col("ring"), F.lit(0.0), lambda a, p: a + p[i]) / F.size("ring")
    return parsed.select(ring.alias("ring")).filter(F.size("ring") > 0).select(mean(0).alias("lon"), mean(1).alias("lat"))
