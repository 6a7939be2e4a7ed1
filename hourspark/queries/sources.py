"""Sources and sinks: rows of a given table are written in a form and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions import geo
from hourspark.operators import ordered
from hourspark.operators.intervals import repaired_hours
from hourspark.operators.quality import ContractError
from hourspark.queries import Tables, query
from hourspark.queries.spatial import order_points
from hourspark.session import cut, run_dir
from hourspark.sources import feeds, landing, readers, sinks

# A text with a quote, a separator and a line feed.
NOTE_SQL = """o_orderstatus || ', "' || o_orderdate::DATE::VARCHAR || '";' || chr(10) || o_custkey"""
ORDER_TEXTS = ["o_orderkey", "o_custkey", "note"]


def order_texts(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("string")
    note = F.concat(F.col("o_orderstatus"), F.lit(', "'), day, F.lit('";\n'), F.col("o_custkey").cast("string"))
    note = F.when(F.col("o_custkey") % 5 != 0, note)
    return t.orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), note.alias("note"))


ORDER_TEXTS_SQL = f"SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 <> 0 THEN {NOTE_SQL} END AS note FROM orders"


def typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "note")


def _packed(files: dict[str, bytes], how: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as archive:
        for name, data in files.items():
            archive.writestr(name, data)
    return out.getvalue()


def _zipped(folder: str):  # type: ignore[no-untyped-def]
    """An archive for each batch of rows: a plain member, a compressed and a stored inner archive."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), []  # type: ignore[union-attr]
        for k, rows in enumerate(batches):
            thirds = [rows.iloc[i::3].to_csv(index=False).encode() for i in range(3)]
            month = _packed({"01/b.csv": thirds[1], "__MACOSX/b.csv": b"junk"})
            archive = _packed({"a.csv": b"\xef\xbb\xbf" + thirds[0], "01.zip": month, "notes.txt": b"no"})
            name = f"{folder}/vic_orders_{task}/{k}.zip"
            store, path = fs.FileSystem.from_uri(name if "://" in name else name.removeprefix("file:"))
            store.create_dir(path.rsplit("/", 1)[0])
            for file, data in ((path, archive), (path.replace(".zip", "s.zip"), _packed({"02.zip": _packed({"c.csv": thirds[2]})}, zipfile.ZIP_STORED))):
                with store.open_output_stream(file) as out:
                    out.write(data)
            made.append((name, len(rows)))
        yield pd.DataFrame(made, columns=["file", "rows"])

    return write


@query(ORDER_TEXTS_SQL)
def zip_round_trip(t: Tables) -> DataFrame:
    """Orders written as CSV members of nested ZIP archives and read back from them."""
    folder = run_dir(t.spark, "zipped")
    cut(order_texts(t).mapInPandas(_zipped(folder), "file string, rows long"))
    found = readers.discover(t.spark, folder, "*.zip", "vic_orders_")
    members = landing.list_members(t.spark, folder).join(found.withColumnRenamed("file", "path"), "path")
    return typed(landing.land(t.spark, members, ORDER_TEXTS, run_dir(t.spark, "landed")))


@query(ORDER_TEXTS_SQL)
def csv_round_trip(t: Tables) -> DataFrame:
    """Orders written as headed CSV files and scanned with an explicit schema."""
    return typed(delimited(t, ","))


@query(ORDER_TEXTS_SQL)
def semicolon_round_trip(t: Tables) -> DataFrame:
    """The same with semicolons."""
    return typed(delimited(t, ";"))


def delimited(t: Tables, sep: str) -> DataFrame:
    path = run_dir(t.spark, "delimited")
    rows = order_texts(t).withColumn("note", F.translate("note", "\n", "|"))  # a scan splits files at line feeds
    rows.write.csv(path, header=True, sep=sep, escape='"')
    read = readers.read_csv(t.spark, path, readers.text_schema(ORDER_TEXTS), sep)
    return read.withColumn("note", F.translate("note", "|", "\n"))


@query(f"SELECT source_dataset_id, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, 'snapshot_' || o_orderstatus AS source_dataset_id FROM orders) GROUP BY 1")
def multi_file_relation(t: Tables) -> DataFrame:
    """A table in a folder per source, read as one relation that knows its sources."""
    home = run_dir(t.spark, "sources")
    marked = t.orders.withColumn("s", F.concat(F.lit("snapshot_"), "o_orderstatus"))
    marked.write.partitionBy("s").parquet(home)
    paths = [f"{home}/s={r.s}" for r in marked.select("s").distinct().collect()]  # a handful of sources
    rows = readers.with_source(readers.read_parquet(t.spark, paths, None), "s=snapshot_")
    named = rows.withColumn("source_dataset_id", F.regexp_replace("source_dataset_id", "^s=", ""))
    return named.groupBy("source_dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("SELECT round(o_totalprice / 10000, 6) AS lon, round(-(o_orderkey % 90) - 0.5, 6)::DOUBLE AS lat FROM orders")
def point_lines(t: Tables) -> DataFrame:
    """Points written as lines of ``lat, lon`` and read back."""
    path = run_dir(t.spark, "points")
    lon, lat = F.round(F.col("o_totalprice") / 10000, 6), F.round(-F.pmod("o_orderkey", F.lit(90)) - 0.5, 6)
    t.orders.select(F.format_string('"%.6f, %.6f"', lat.cast("double"), lon.cast("double"))).write.text(path)
    return readers.read_point_lines(t.spark, path).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT n_nationkey::BIGINT AS place, n_name, (SELECT count(*) FROM nation b WHERE b.n_regionkey < a.n_regionkey OR (b.n_regionkey = a.n_regionkey AND b.n_name < a.n_name))::BIGINT AS rank FROM nation a")
def report_round_trip(t: Tables) -> DataFrame:
    """Nations written as an ordered CSV report; the order is read back from the files."""
    path = run_dir(t.spark, "report")
    sinks.write_report(t.nation.select("n_regionkey", "n_name", F.col("n_nationkey").alias("place")), path, ["n_regionkey", "n_name"])
    rows = t.spark.read.csv(path, header=True, schema="n_regionkey int, n_name string, place bigint").select("*", "_metadata.file_name", "_metadata.file_block_start")
    at = rows.withColumn("at", F.monotonically_increasing_id())  # files in name order, rows in file order
    placed = ordered.numbered(at, [], ["file_name", "at"], F.lit(0), "rn")
    return placed.select("place", "n_name", (F.col("rn") - 1).alias("rank"))


# Map documents ---------------------------------------------------------------------------------


def map_lines(t: Tables) -> DataFrame:
    """Each customer's orders by key as a line of points; a document holds the customers of one nation."""
    points = order_points(t).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    return points.groupBy("c_nationkey", "c_custkey").agg(line.alias("line"))


def documents(lines: DataFrame, feature: Column, name: str) -> DataFrame:
    """One JSON document per nation, its features in customer order."""
    told = F.struct("c_custkey", F.to_json(feature).alias("f"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["f"]), ", ")
    return cut(lines.groupBy(F.col("c_nationkey").alias("document")).agg(F.concat(F.lit(f'{{"{name}": ['), listed, F.lit("]}")).alias("payload")))


POINTS_SQL = """p AS (SELECT o_orderkey, o_custkey, c_nationkey, 144.88::DOUBLE + ((o_custkey * 97 + (o_orderkey % 89) * (o_orderkey % 13)) * 48611 % 100003) / 100003.0::DOUBLE * 0.24::DOUBLE AS lon,
    -37.92::DOUBLE + ((o_custkey * 97 + (o_orderkey % 89) * (o_orderkey % 13)) * 611953 % 99991) / 99991.0::DOUBLE * 0.19::DOUBLE AS lat FROM orders JOIN customer ON c_custkey = o_custkey),
  v AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM p),
  u AS (SELECT *, row_number() OVER (ORDER BY c_nationkey, o_custkey, i) - 1 AS ordinal FROM v WHERE n > 1 {where})
  SELECT a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, round(a.lon, 9) AS lon_a, round(a.lat, 9) AS lat_a, round(b.lon, 9) AS lon_b, round(b.lat, 9) AS lat_b
  FROM u a JOIN u b ON b.o_custkey = a.o_custkey AND b.i = a.i + 1"""


def rounded_ends(segments: DataFrame) -> DataFrame:
    return segments.select("ordinal_a", "ordinal_b", *[F.round(c, 9).alias(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b")])


@query("WITH " + POINTS_SQL.format(where=""))
def line_documents(t: Tables) -> DataFrame:
    """Lines written as feature collections, one a nation, and read back as numbered segments."""
    shape = F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates"))
    read = feeds.line_features(documents(map_lines(t), F.struct(shape.alias("geometry")), "features"))
    return rounded_ends(feeds.segments_of(read))


@query("WITH " + POINTS_SQL.format(where="AND o_custkey % 4 IN (0, 1)"))
def way_documents(t: Tables) -> DataFrame:
    """The same as ways; motorways and closed ways are left out."""
    key = F.col("c_custkey") % 4
    tags = F.when(key == 0, F.create_map(F.lit("highway"), F.lit("footway"))).when(
        key == 1, F.create_map(F.lit("highway"), F.lit("path"), F.lit("access"), F.lit("yes"))
    ).when(key == 2, F.create_map(F.lit("highway"), F.lit("motorway"))).otherwise(F.create_map(F.lit("highway"), F.lit("path"), F.lit("foot"), F.lit("no")))
    geometry = F.transform("line", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    way = F.struct(F.lit("way").alias("type"), F.col("c_custkey").alias("id"), tags.alias("tags"), geometry.alias("geometry"))
    return rounded_ends(feeds.segments_of(feeds.walkable_ways(documents(map_lines(t), way, "elements"))))


@query("""WITH p AS (SELECT o_custkey, round(avg(lon), 6) AS mean_lon, round(avg(lat), 6) AS mean_lat, round(arg_min(lon, o_orderkey), 6) AS lon, round(arg_min(lat, o_orderkey), 6) AS lat FROM (
    SELECT o_orderkey, o_custkey, 144.88::DOUBLE + ((o_custkey * 97 + (o_orderkey % 89) * (o_orderkey % 13)) * 48611 % 100003) / 100003.0::DOUBLE * 0.24::DOUBLE AS lon,
      -37.92::DOUBLE + ((o_custkey * 97 + (o_orderkey % 89) * (o_orderkey % 13)) * 611953 % 99991) / 99991.0::DOUBLE * 0.19::DOUBLE AS lat FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1)
  SELECT CASE WHEN o_custkey % 3 = 0 THEN lon ELSE mean_lon END AS lon, CASE WHEN o_custkey % 3 = 0 THEN lat ELSE mean_lat END AS lat FROM p""")
def point_documents(t: Tables) -> DataFrame:
    """Point, polygon and multipolygon features, read back as one point each."""
    lines, key = map_lines(t), F.col("c_custkey") % 3
    text = F.when(key == 0, F.to_json(F.col("line")[0])).when(key == 1, F.to_json(F.array("line"))).otherwise(F.to_json(F.array(F.array("line"))))
    kind = F.when(key == 0, "Point").when(key == 1, "Polygon").otherwise("MultiPolygon")
    feature = F.concat(F.lit('{"geometry": {"type": "'), kind, F.lit('", "coordinates": '), text, F.lit("}}"))
    told = lines.groupBy(F.col("c_nationkey").alias("document")).agg(F.concat(F.lit('{"features": ['), F.array_join(F.collect_list(feature), ", "), F.lit("]}")).alias("payload"))
    return feeds.feature_points(cut(told)).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


# Binary points and hour repair ------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN (o_custkey % 180)::DOUBLE END AS lon, CASE WHEN o_orderkey % 5 IN (0, 1) THEN (-(o_orderkey % 64))::DOUBLE END AS lat FROM orders""")
def wkb_points(t: Tables) -> DataFrame:
    """Points in well-known binary of both byte orders; lines, short values and nulls are none."""
    key = F.col("o_orderkey") % 5
    at = t.orders.select("o_orderkey", key.alias("key"), (F.col("o_custkey") % 180).cast("int").alias("x"), (-(F.col("o_orderkey") % 64)).cast("int").alias("y"))
    big = lambda c: double_hex(F.col(c))
    turned = lambda h: F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    raw = F.when(key_is(0), F.concat(F.lit("0000000001"), big("x"), big("y"))).when(
        key_is(1), F.concat(F.lit("0101000000"), turned(big("x")), turned(big("y")))
    ).when(key_is(2), F.concat(F.lit("0000000002"), big("x"), big("y"))).when(key_is(3), F.concat(F.lit("0000000001"), big("x")))
    point = geo.wkb_point(F.unhex(raw))
    read = cut(at.select("o_orderkey", point.alias("p")))
    return read.select("o_orderkey", "p.lon", "p.lat")


def key_is(value: int) -> Column:
    return F.col("key") == value


def double_hex(whole: Column) -> Column:
    """Hex digits of the IEEE double of a small whole number, the sign first: exponent and mantissa from its bits."""
    size = F.abs(whole).cast("bigint")
    power = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    mantissa = F.call_function("shiftleft", size - F.call_function("shiftleft", F.lit(1).cast("bigint"), power), 52 - power)
    bits = F.shiftleft((power + 1023).cast("bigint"), 52) + mantissa
    signed = F.when(whole < 0, bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)
    return F.when(whole == 0, F.lit("0" * 16)).otherwise(F.lpad(F.hex(signed), 16, "0"))


REPAIR_SQL = """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders), d AS (SELECT *, k // 408 AS day FROM n WHERE k < (SELECT count(*) FROM orders) // 408 * 408)"""


@query(f"{REPAIR_SQL} SELECT o_orderkey, (k % 408 // 17)::INTEGER AS recovered_hour FROM d")
def hour_repair(t: Tables) -> DataFrame:
    """Days of 24 runs over the same 17 units, all published with hour 0: hours come back from row positions."""
    return repaired_hours(hour_block(t), "day", "unit", "row", "hour", "o_orderkey", days=None)


@query(f"""{REPAIR_SQL} SELECT shape, (SELECT count(*) FROM d) AS rows, shape <> 'repeated runs' AS refused FROM (VALUES ('repeated runs'), ('two units swapped'), ('a row lost'), ('an hour told')) AS s(shape)""")
def hour_repair_shapes(t: Tables) -> DataFrame:
    """Which shapes of the same block are refused."""
    block, first = hour_block(t), F.col("row") == 40
    swapped = F.when(first, (F.col("unit") + 1) % 17).otherwise(F.col("unit"))
    shapes = {
        "repeated runs": block, "two units swapped": block.withColumn("unit", swapped), "a row lost": block.filter(~first),
        "an hour told": block.withColumn("hour", F.when(first, 1).otherwise(0)),
    }
    told = []
    for name, rows in shapes.items():
        try:
            repaired_hours(rows, "day", "unit", "row", "hour", "o_orderkey", days=None)
            told.append((name, False))
        except ContractError:
            told.append((name, True))
    marks = F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), F.lit(r).alias("refused")) for n, r in told]))
    return block.agg(F.count(F.lit(1)).alias("rows")).select(marks.alias("m"), "rows").select("m.shape", "rows", "m.refused")


def hour_block(t: Tables) -> DataFrame:
    placed = ordered.numbered(t.orders.select("o_orderkey"), [], ["o_orderkey"], F.floor(F.col("o_orderkey") / F.lit(2**16)), "rn")
    whole = t.orders.agg((F.floor(F.count(F.lit(1)) / 408) * 408).alias("n")).scalar()
    rows = placed.withColumn("k", F.col("rn") - 1).filter(F.col("k") < whole)
    return cut(rows.select("o_orderkey", F.col("rn").alias("row"), F.floor(F.col("k") / 408).alias("day"), (F.col("k") % 17).alias("unit"), F.lit(0).alias("hour")))
