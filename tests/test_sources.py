import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hourspark.operators.quality import ContractError
from hourspark.sources import feeds, landing, readers, sinks


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def archives(tmp_path):
    home = tmp_path / "vic_scats_2024"
    home.mkdir()
    month = lambda m: packed({f"{m}/a.csv": f"x,y\n{m},1\n{m},\n", "__MACOSX/a.csv": "junk"})
    (home / "year.zip").write_bytes(packed({"01.zip": month("01"), "02.zip": month("02"), "top.csv": "﻿x,y,z\n9,8,7\n", "notes.txt": "no"}))
    return tmp_path


def test_members_of_nested_archives_are_landed(spark, archives, tmp_path):
    members = landing.list_members(spark, str(archives))
    assert sorted((r.nested or "", r.member) for r in members.collect()) == [("", "top.csv"), ("01.zip", "01/a.csv"), ("02.zip", "02/a.csv")]
    table = landing.land(spark, members, ["y", "x"], str(tmp_path / "out"))
    got = sorted((r.member, r.row_number, r.x, r.y) for r in table.collect() if r.member != "top.csv")
    assert [g[:3] for g in got] == [("01.zip::01/a.csv", 1, "01"), ("01.zip::01/a.csv", 2, "01"), ("02.zip::02/a.csv", 1, "02"), ("02.zip::02/a.csv", 2, "02")]
    assert [g[3] for g in got] == ["1", None, "1", None]
    assert table.filter("member = 'top.csv'").first().x == "9"


def test_members_are_streamed_in_partitions(spark, tmp_path, monkeypatch):
    """Stored inner archives are read in place, a partition a member; quotes, line feeds and empty fields hold."""
    text = "a,b,c\r\n" + "".join(f'{k},"x ""{k}""\n,y",{k if k % 3 else ""}\r\n' for k in range(40_000))
    inner = {f"m{k}.csv": text for k in range(3)} | {"none.csv": "c,b,a\n"}
    stored, tight = packed(inner), io.BytesIO()
    with zipfile.ZipFile(tight, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("tight.zip", stored)
    (tmp_path / "one.zip").write_bytes(packed({"plain.zip": stored}))
    (tmp_path / "two.zip").write_bytes(tight.getvalue())
    members = landing.list_members(spark, str(tmp_path))
    assert {(r.nested, r.in_place) for r in members.collect()} == {("plain.zip", True), ("tight.zip", False)}
    rows = landing.scan(spark, members, ["c", "b"])
    assert rows.rdd.getNumPartitions() == 5  # four members in place, and one compressed archive
    facts = rows.agg(F.count("*").alias("n"), F.count("c").alias("c"), F.max("row_number").alias("last"), F.count_distinct("path", "member").alias("members")).first()
    assert (facts.n, facts.c, facts.last, facts.members) == (240_000, 6 * 26_666, 40_000, 6)
    assert rows.filter("row_number = 8 AND member = 'plain.zip::m1.csv'").first().b == 'x "7"\n,y'
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.zip").write_bytes(packed({"b.csv": "a,b\n1,2\n3\n"}))
    with pytest.raises(Exception):
        landing.scan(spark, landing.list_members(spark, str(tmp_path / "bad")), ["a", "b"]).count()


def test_missing_columns_and_sources_fail(spark, archives, tmp_path):
    with pytest.raises(Exception, match="lacks columns"):
        landing.land(spark, landing.list_members(spark, str(archives)), ["x", "absent"], str(tmp_path / "bad"))
    found = readers.discover(spark, str(archives), "*.zip", "vic_scats_", ["vic_scats_2024"])
    assert [r.source_dataset_id for r in found.collect()] == ["vic_scats_2024"]
    with pytest.raises(ContractError, match="vic_scats_2025"):
        readers.discover(spark, str(archives), "*.zip", "vic_scats_", ["vic_scats_2024", "vic_scats_2025"])
    with pytest.raises(ContractError):
        readers.discover(spark, str(archives), "*.zip", "vic_scats_", [])


def test_delimited_scan_refuses_another_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;place\n1;x\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), readers.text_schema(["id", "place"]), ";").collect()] == [("1", "x")]
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "a.csv"), readers.text_schema(["id", "town"]), ";").collect()


def test_point_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text("geo_point_2d\n-37.81, 144.96\n\n-37.82,144.97\n")
    assert sorted(tuple(r) for r in readers.read_point_lines(spark, str(tmp_path / "p.csv")).collect()) == [(144.96, -37.81), (144.97, -37.82)]


def payload(spark, **series):
    doc = {"header": {"fill_value": -99.0}, "properties": {"parameter": series}}
    return spark.createDataFrame([(json.dumps(doc),)], "payload string")


def hours(values):
    return {f"20240101{h:02d}": v for h, v in enumerate(values)}


def test_hourly_series(spark):
    day = F.lit("2024-01-01").cast("date")
    df = payload(spark, T2M=hours([1.5, -999, -99] + [0.0] * 21), PRECTOT=hours([2.0] * 24))
    out = feeds.hourly_series(df, ["T2M", "PRECTOTCORR"], day, day, {"PRECTOTCORR": "PRECTOT"})
    got = out.collect()
    assert len(got) == 24 and [r.T2M for r in got[:4]] == [1.5, None, None, 0.0] and got[0].PRECTOTCORR == 2.0
    for bad in (hours([1.0] * 23), hours([1.0] * 24) | {"2024010200": 1.0}, hours([1.0] * 24) | {"20240101000": 1.0}):
        with pytest.raises(ContractError):
            feeds.hourly_series(payload(spark, T2M=bad), ["T2M"], day, day)
    with pytest.raises(ContractError):
        feeds.hourly_series(payload(spark, T2M=hours([1.0] * 24)), ["PS"], day, day)


def doc(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "payload string")


def doc_at(spark, *documents):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in documents], "document long, payload string")


def test_line_features_and_ways(spark):
    line = lambda *p: {"geometry": {"type": "LineString", "coordinates": [list(x) for x in p]}}
    lines = doc_at(spark, (7, {"features": [{"geometry": {"type": "Point", "coordinates": []}}, line((1.0, 2.0), (3.0, 4.0), (5.0, 6.0)), line((0.0, 0.0))]}),
                   (2, {"features": [line((9.0, 9.0), (8.0, 8.0)), line((7.0, 7.0), (6.0, 6.0))]}))
    segments = feeds.segments_of(feeds.line_features(lines))
    assert [tuple(r) for r in segments.orderBy("ordinal_a").collect()] == [
        (2, 0, 0, 9.0, 9.0, 1, 8.0, 8.0), (2, 1, 2, 7.0, 7.0, 3, 6.0, 6.0), (7, 1, 4, 1.0, 2.0, 5, 3.0, 4.0), (7, 1, 5, 3.0, 4.0, 6, 5.0, 6.0),
    ]
    geometry = [{"lat": 1.0, "lon": 2.0}, {"lat": 3.0, "lon": 4.0}]
    way = lambda i, tags, g=geometry, kind="way": {"type": kind, "id": i, "tags": tags, "geometry": g}
    ways = doc_at(spark, (0, {"elements": [way(1, {"highway": "footway"}), way(2, {"highway": "motorway"}), way(3, {"highway": "path", "foot": "no"}), way(4, {"highway": "path", "access": "private"}),
                                           way(5, {"highway": "path"}, geometry[:1]), way(6, {"highway": "path"}, kind="node")]}))
    assert [(r.way_id, r.coordinates) for r in feeds.walkable_ways(ways).collect()] == [(1, [[2.0, 1.0], [4.0, 3.0]])]


def test_a_line_of_more_than_a_million_vertices(spark):
    n = 2**20 + 5
    long = spark.range(1).select(F.lit(0).alias("document"), F.lit(0).alias("feature"), F.expr(f"transform(sequence(1, {n}), i -> array(CAST(i AS double), 0D))").alias("coordinates"))
    next_ = spark.sql("SELECT 0 AS document, 1 AS feature, array(array(1D, 1D), array(2D, 2D)) AS coordinates")
    got = feeds.segments_of(long.unionByName(next_))
    facts = got.agg(F.count("*").alias("n"), F.count_distinct("ordinal_a").alias("a"), F.max("ordinal_b").alias("b"), F.count_if(F.col("lon_b") != F.col("lon_a") + 1).alias("gaps")).first()
    assert (facts.n, facts.a, facts.b, facts.gaps) == (n, n, n + 1, 0)


def test_feature_points(spark):
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    shapes = [{"type": "Point", "coordinates": [5.0, 6.0]}, {"type": "Polygon", "coordinates": [square, square]}, {"type": "MultiPolygon", "coordinates": [[square], [square]]}, {"type": "LineString", "coordinates": square}]
    points = feeds.feature_points(doc(spark, {"features": [{"geometry": s} for s in shapes]}))
    assert [tuple(r) for r in points.collect()] == [(5.0, 6.0), (1.0, 1.0), (1.0, 1.0)]


def test_sinks(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), "id", F.when(F.col("id") < 300, "train").otherwise("test").alias("split"))
    sinks.write_ordered(df, str(tmp_path / "ordered"), ["k", "id"])
    sinks.require_order(spark.read.parquet(str(tmp_path / "ordered")), ["k", "id"])
    df.repartition(3).write.parquet(str(tmp_path / "loose"))
    with pytest.raises(ContractError):
        sinks.require_order(spark.read.parquet(str(tmp_path / "loose")), ["k", "id"])
    sinks.write_table(df, str(tmp_path / "parts"), ["split"], block_bytes=1 << 20)
    assert spark.read.parquet(str(tmp_path / "parts")).filter("split = 'test'").count() == 200
    sinks.write_report(df, str(tmp_path / "report"), ["k", "id"])
    sinks.write_preview(df, str(tmp_path / "preview"), ["id"], 5)
    assert spark.read.csv(str(tmp_path / "preview"), header=True).count() == 5
    made = json.loads(sinks.manifest(df, {"last": F.max("id")}, "split").first().manifest)
    assert (made["rows"], made["last"], made["split_rows"]) == (500, 499, {"test": 200, "train": 300})
    sinks.write_manifest(sinks.manifest(df, {}), str(tmp_path / "manifest"))
    assert spark.read.text(str(tmp_path / "manifest")).count() == 1
