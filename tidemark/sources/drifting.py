"""Parquet whose column types and spellings differ from file to file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.schemas import TRIP_CASTS, TRIP_SPELLINGS
from tidemark.session import finished_versions, is_file, remove_path, staging_path
from tidemark.sinks.tables import write_parquet
from tidemark.sources.tables import parquet_listing

_FILES_PER_TASK = 64


def normalize(
    table: DataFrame,
    casts: Mapping[str, str] = TRIP_CASTS,
    spellings: Mapping[str, Sequence[str]] = TRIP_SPELLINGS,
) -> DataFrame:
    """Give the columns that are there their one name and type, in one projection.

    Names are matched without regard to case. Values that do not fit become
    NULL instead of failing the job.
    """
    names = {s.lower(): canonical for canonical, group in spellings.items() for s in group}
    kinds = {name.lower(): (name, kind) for name, kind in casts.items()}

    def project(column: str):
        canonical = names.get(column.lower(), column)
        name, kind = kinds.get(canonical.lower(), (canonical, None))
        source = F.col(f"`{column}`")
        return (source.try_cast(kind) if kind else source).alias(name)

    return table.select(*[project(column) for column in table.columns])


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows; a column some tables lack is NULL there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tables)


def _footer_reader():
    """The task function. Made here so that it travels by value and tasks need
    nothing but pyarrow."""

    def read(batches):
        from urllib.parse import quote

        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        def layout(path):
            # Spark writes file:/x and s3a://x where Arrow wants file:///x and s3://x.
            scheme, _, rest = quote(path, safe=":/").partition(":")
            uri = "file:///" + rest.lstrip("/") if scheme == "file" else f"{scheme}:{rest}"
            fs, inner = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
            with fs.open_input_file(inner) as file:
                return ", ".join(f"{field.name} {field.type}" for field in pq.read_schema(file))

        for batch in batches:
            yield batch.assign(layout=batch["path"].map(layout))

    return read


def _with_layouts(files: DataFrame) -> DataFrame:
    """``files`` and their footer schemas, read in tasks, a few dozen files each."""
    tasks = max(1, -(-files.count() // _FILES_PER_TASK))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.repartition(tasks, "path").mapInPandas(_footer_reader(), f"{kinds}, layout string")


def _with_folders(files: DataFrame) -> DataFrame:
    return files.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``path, folder, layout``: the files under ``path`` and their footer schemas."""
    return _with_folders(_with_layouts(parquet_listing(spark, path).select("path")))


_FILE_KEY = ["path", "length", "modified"]


@dataclass(frozen=True)
class FooterIndex:
    """Footer schemas kept beside a table, so that an unchanged file's footer is read once.

    A file is known by path, length and time of change. Each refresh that finds a difference
    writes a new version below ``root``; a version counts when its write has finished, and
    the one before it stays for readers that have begun. ``root`` must not be
    below the table, unless in a folder whose name begins with ``_``. One writer at a time.
    """

    root: str

    def _version(self, number: int) -> str:
        return f"{self.root}/version={number}"

    def files(self, spark: SparkSession) -> DataFrame | None:
        """Path, length, time of change and layout of the files last seen."""
        versions = finished_versions(spark, self.root)
        return spark.read.parquet(self._version(versions[-1])) if versions else None

    def refresh(self, spark: SparkSession, path: str) -> int:
        """Make the index that of the files now under ``path``; tells how many footers it read."""
        listing, known = parquet_listing(spark, path), self.files(spark)
        versions = finished_versions(spark, self.root)
        if known is None:
            fresh, kept = listing, None
        else:
            fresh = listing.join(known, _FILE_KEY, "left_anti")
            kept = known.join(listing, _FILE_KEY, "left_semi")
        opened = fresh.count()
        if kept is not None and not opened and kept.count() == known.count():
            return 0
        if kept is None:
            rows = _with_layouts(fresh)
        else:
            rows = kept.unionByName(_with_layouts(fresh)) if opened else kept
        write_parquet(rows, self._version(versions[-1] + 1 if versions else 0))
        for number in versions[:-1]:
            remove_path(spark, self._version(number))
        return opened

    def layouts(self, spark: SparkSession, path: str) -> DataFrame:
        """What ``file_layouts`` gives, with the footers of new and changed files read only."""
        self.refresh(spark, path)
        return _with_folders(self.files(spark).select("path", "layout"))


def scan_units(spark: SparkSession, path: str, index: FooterIndex | None = None) -> list[tuple[str, list[str]]]:
    """(layout, what to read) for each layout, in the order of its first file.

    A folder whose own files share a layout is read as a folder, so that only names of
    folders go to the driver; the files of a mixed folder are named one by one. With
    an ``index`` only new and changed footers are read.
    """
    if index is not None:
        files = index.layouts(spark, path)
    else:
        staged = staging_path(spark, "layouts")
        file_layouts(spark, path).write.parquet(staged)
        files = spark.read.parquet(staged)
    folders = files.groupBy("folder").agg(
        F.min("layout").alias("layout"), F.max("layout").alias("other"), F.min("path").alias("first")
    )
    rows = sorted(folders.toLocalIterator(), key=lambda r: f"{r['folder']}/")
    # A folder above another one would be read with it.
    above = {r["folder"] for r, after in zip(rows, rows[1:]) if after["folder"].startswith(f"{r['folder']}/")}
    mixed = [r["folder"] for r in rows if r["layout"] != r["other"] or r["folder"] in above]
    found = [(r["first"], r["layout"], r["folder"]) for r in rows if r["folder"] not in set(mixed)]
    if mixed:
        named = files.where(F.col("folder").isin(mixed))
        found += [(r["path"], r["layout"], r["path"]) for r in named.toLocalIterator()]
    units: dict[str, list[str]] = {}
    for _, layout, unit in sorted(found):
        units.setdefault(layout, []).append(unit)
    return list(units.items())


def read_drifting_parquet(
    spark: SparkSession,
    path: str,
    casts: Mapping[str, str] = TRIP_CASTS,
    spellings: Mapping[str, Sequence[str]] = TRIP_SPELLINGS,
    index: FooterIndex | None = None,
) -> DataFrame:
    """Every parquet file under ``path`` normalised and put together by name.

    Files that share a schema are one scan, so the plan grows with the number
    of schemas and not with the number of files; with one schema the folder itself
    is read.
    """
    if is_file(spark, path):
        return normalize(spark.read.parquet(path), casts, spellings)
    units = scan_units(spark, path, index)
    if len(units) < 2:
        whole = spark.read.option("recursiveFileLookup", "true") if units else spark.read
        return normalize(whole.parquet(path), casts, spellings)
    return union_by_name([normalize(spark.read.parquet(*names), casts, spellings) for _, names in units])
