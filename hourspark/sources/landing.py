"""CSV members of ZIP archives, nested ones included, as a Spark data source.

The members are listed by one task an archive.  ``zip_csv`` then reads one member in a partition and hands it on as
Arrow batches of a streaming CSV reader, so neither an archive nor a member is held.  An inner archive that was
stored as it is is read in place; of a compressed one the packed bytes are held, and its members are one partition.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER_SCHEMA = "path string, nested string, member string, bytes bigint, in_place boolean"
BLOCK_BYTES = 4 << 20  # of text that the CSV reader takes at a time; a row must fit


def _data_names(archive: zipfile.ZipFile, suffix: str) -> list[str]:
    return sorted(n for n in archive.namelist() if n.lower().endswith(suffix) and not n.startswith("__MACOSX/"))


def _open(path: str):  # type: ignore[no-untyped-def]
    """Stream of a stored archive: the cluster mounts or fetches it through Arrow's file systems."""
    from pyarrow import fs

    plain = path[5:] if path.startswith("file:") else path
    while plain.startswith("//"):
        plain = plain[1:]
    if "://" in plain:
        store, inner = fs.FileSystem.from_uri(plain)
        return store.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(plain)


def _in_place(archive: zipfile.ZipFile, nested: str) -> bool:
    return archive.getinfo(nested).compress_type == zipfile.ZIP_STORED


def _inner(archive: zipfile.ZipFile, nested: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(archive.open(nested) if _in_place(archive, nested) else io.BytesIO(archive.read(nested)))


def _list_members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path in frame["path"]:
            with _open(path) as handle, zipfile.ZipFile(handle) as archive:
                rows += [(path, None, m, archive.getinfo(m).file_size, True) for m in _data_names(archive, ".csv")]
                for nested in _data_names(archive, ".zip"):
                    with _inner(archive, nested) as month:
                        stored = _in_place(archive, nested)
                        rows += [(path, nested, m, month.getinfo(m).file_size, stored) for m in _data_names(month, ".csv")]
        yield pd.DataFrame(rows, columns=["path", "nested", "member", "bytes", "in_place"])


def list_members(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """(path, nested, member, bytes, in_place) of every CSV member under ``folder``; only names are read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    )
    return files.select("path").repartition("path").mapInPandas(_list_members, MEMBER_SCHEMA)


@dataclass
class Unit(InputPartition):
    """One member, or all members of one compressed inner archive."""

    path: str
    nested: str | None
    members: list[str]


class ZipCsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.units = json.loads(options["units"])
        self.columns, self.sep = json.loads(options["columns"]), options.get("sep", ",")

    def partitions(self) -> list[Unit]:
        return [Unit(*unit) for unit in self.units]

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        with _open(partition.path) as handle, zipfile.ZipFile(handle) as outer:
            if partition.nested is None:
                for member in partition.members:
                    yield from self._rows(outer, partition, member)
                return
            with _inner(outer, partition.nested) as inner:
                for member in partition.members:
                    yield from self._rows(inner, partition, member)

    def _rows(self, archive: zipfile.ZipFile, unit: Unit, member: str) -> Iterator[pa.RecordBatch]:
        label = member if unit.nested is None else f"{unit.nested}::{member}"
        with archive.open(member) as raw:
            header = next(csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), delimiter=self.sep), [])
        absent = sorted(set(self.columns) - set(header))
        if absent:
            raise ValueError(f"{unit.path}::{label} lacks columns {absent}")
        names = ["path", "member", "row_number", *self.columns]
        with archive.open(member) as raw:
            batches = arrow_csv.open_csv(
                raw, arrow_csv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES, column_names=header, skip_rows=1),
                arrow_csv.ParseOptions(delimiter=self.sep, newlines_in_values=True),
                arrow_csv.ConvertOptions(
                    column_types={c: pa.string() for c in self.columns}, include_columns=self.columns, null_values=[""],
                    strings_can_be_null=True, quoted_strings_can_be_null=True,
                ),
            ) if archive.getinfo(member).file_size > 0 else []
            done = 0
            for batch in batches:
                n = batch.num_rows
                numbers = pa.array(range(done + 1, done + n + 1), pa.int64())
                own = [pa.array([text] * n, pa.string()) for text in (unit.path, label)]
                yield pa.RecordBatch.from_arrays([*own, numbers, *batch.columns], names)
                done += n


class ZipCsv(DataSource):
    """Options: ``units`` (list of path, nested, members), ``columns`` (names) and ``sep``."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        columns = json.loads(self.options["columns"])
        return ", ".join(["path string", "member string", "row_number bigint", *[f"`{c}` string" for c in columns]])

    def reader(self, schema: object) -> ZipCsvReader:
        return ZipCsvReader(dict(self.options))


def scan(spark: SparkSession, members: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """path, member, row_number (1-based position in the member) and ``columns`` as text; empty fields are null.

    A member without one of the columns, or with a row that is not as wide as its header, fails the scan.  The
    driver holds the members' names, as it does for any file scan.
    """
    units: dict[tuple, list[str]] = {}
    for r in members.orderBy("path", "nested", "member").collect():
        alone = r.nested is None or r.in_place
        units.setdefault((r.path, r.nested, r.member if alone else None), []).append(r.member)
    spark.dataSource.register(ZipCsv)
    told = json.dumps([[path, nested, names] for (path, nested, _), names in units.items()])
    return spark.read.format("zip_csv").options(units=told, columns=json.dumps(columns), sep=sep).load()


def land(spark: SparkSession, members: DataFrame, columns: list[str], out: str, sep: str = ",") -> DataFrame:
    """Write the members' rows as Parquet under ``out`` and return that table."""
    rows = scan(spark, members, columns, sep)
    rows.write.mode("errorifexists").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)
