"""Tables of parquet files written in Python with commits, read by row groups that filters leave, and followed as a stream.

A committed table is a folder of parquet files and a manifest that names those that count,
in the order of their commits. Tasks write into a staging folder of their job; a commit moves
what the tasks of the job have told it, replaces the manifest by one rename and deletes the
staging folder, and an abort only deletes that folder. So a reader sees all of a job or none,
and files of failed or repeated attempts are never read. Jobs of one table must not overlap.

Files are reached through pyarrow's file systems: local paths and the URIs it knows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tidewheel.session import table
from tidewheel.storage import shared_folder

MANIFEST = "_manifest.json"
#: Files of a table up to which its row groups are planned one by one; of more, each file is a task that looks at its own.
PLANNED = 1024


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


def _manifest(fs: pafs.FileSystem, folder: str) -> list[str] | None:
    at = f"{folder}/{MANIFEST}"
    if fs.get_file_info(at).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())["files"]


def files(path: str) -> list[str]:
    """The parquet files of a table: those its manifest names, in order, or else all, by name."""
    fs, at = _opened(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [at]
    named = _manifest(fs, at)
    if named is not None:
        return [f"{at}/{name}" for name in named]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    shown = lambda p: not any(part[0] in "._" for part in p.removeprefix(at).strip("/").split("/"))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet") and shown(f.path))


@dataclass
class Written(WriterCommitMessage):
    """A task's file in the staging folder; none if it had no rows."""

    file: str | None
    rows: int


class CommittedTable(DataSource):
    """A committed table. Options: path."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self):
        every = files(self.options["path"])
        if not every:
            raise ValueError(f"no parquet files in {self.options['path']}")
        fs, _ = _opened(self.options["path"])
        return from_arrow_schema(pq.read_schema(every[0], filesystem=fs), prefer_timestamp_ntz=True)

    def reader(self, schema) -> DataSourceReader:
        return GroupReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return CommitStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return StagedWriter(self.options["path"], to_arrow_schema(schema), overwrite)


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: pa.Schema, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{_opened(self.path)[1]}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _ = _opened(self.path)
        task = TaskContext.get()
        # An attempt has a file of its own, so one that is repeated or runs twice spoils nothing.
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job}.parquet"
        out, rows = None, 0
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        fs.create_dir(self._staging(), recursive=True)
                        out = pq.ParquetWriter(f"{self._staging()}/{name}", batch.schema, filesystem=fs, compression="zstd")
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _opened(self.path)
        fs.create_dir(folder, recursive=True)
        new, old = [m.file for m in messages if m and m.file], _manifest(fs, folder)
        for name in new:
            fs.move(f"{self._staging()}/{name}", f"{folder}/{name}")
        if not new and (self.overwrite or not old):
            new = [self._empty(fs, folder)]
        old = old or []
        told = f"{folder}/_{self.job}.json"
        with fs.open_output_stream(told) as f:
            f.write(json.dumps({"files": new if self.overwrite else old + new}).encode())
        fs.move(told, f"{folder}/{MANIFEST}")
        for name in old if self.overwrite else []:
            fs.delete_file(f"{folder}/{name}")
        self._clear(fs)

    def _empty(self, fs: pafs.FileSystem, folder: str) -> str:
        """A file without rows, which keeps the schema of a table that has none."""
        name = f"part-empty-{self.job}.parquet"
        pq.write_table(self.schema.empty_table(), f"{folder}/{name}", filesystem=fs)
        return name

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(_opened(self.path)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        if fs.get_file_info(self._staging()).type == pafs.FileType.Directory:
            fs.delete_dir(self._staging())


def may_hold(group: pq.RowGroupMetaData, filters: list[Filter]) -> bool:
    """Whether a row group can have rows that pass all filters, by its statistics."""
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    return all(_may_pass(columns.get(".".join(f.attribute)), f, group.num_rows) for f in filters)


def _may_pass(column: pq.ColumnChunkMetaData | None, f: Filter, rows: int) -> bool:
    stats = column.statistics if column is not None and column.is_stats_set else None
    if stats is None:
        return True
    nulls = stats.null_count if stats.has_null_count else None
    if isinstance(f, IsNull):
        return nulls is None or nulls > 0
    if nulls == rows:
        return isinstance(f, EqualNullSafe) and f.value is None
    if isinstance(f, IsNotNull) or not stats.has_min_max:
        return True
    # NaN is above all numbers and in no statistics.
    top = math.inf if column.physical_type in ("FLOAT", "DOUBLE") else None
    try:
        low, high = stats.min, stats.max
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return top is not None or (high > f.value if isinstance(f, GreaterThan) else high >= f.value)
        if isinstance(f, LessThan):
            return low < f.value
        if isinstance(f, LessThanOrEqual):
            return low <= f.value
        if isinstance(f, StringStartsWith):
            return low[: len(f.value)] <= f.value <= high[: len(f.value)]
        if isinstance(f, EqualNullSafe) and f.value is None:
            return nulls != 0
        wanted = f.value if isinstance(f, In) else (f.value,)
        return any(v != v or low <= v <= high for v in wanted if v is not None)
    except TypeError:  # statistics of another kind than the value
        return True


@dataclass
class Group(InputPartition):
    """A file and its row groups to read; None: all that the filters leave."""

    file: str
    groups: list[int] | None


@dataclass
class GroupReader(DataSourceReader):
    """Reads row groups. Filters that statistics can answer leave out groups, and Spark applies all of them to the rows."""

    path: str
    filters: list[Filter] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        known = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull, StringStartsWith)
        self.filters = [f for f in filters if isinstance(f, known)]
        return filters

    def partitions(self) -> list[InputPartition]:
        every, (fs, _) = files(self.path), _opened(self.path)
        if len(every) > PLANNED:
            return [Group(file, None) for file in every]
        return [Group(file, [g]) for file in every for g in self._left(pq.read_metadata(file, filesystem=fs))]

    def _left(self, meta: pq.FileMetaData) -> list[int]:
        return [g for g in range(meta.num_row_groups) if may_hold(meta.row_group(g), self.filters)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        if partition is None:  # no group is left
            return
        file = pq.ParquetFile(partition.file, filesystem=fs)
        yield from file.iter_batches(row_groups=self._left(file.metadata) if partition.groups is None else partition.groups)


class CommitStream(DataSourceStreamReader):
    """The files of a table in the order of their commits; an offset is how many have been read, so it holds after any restart.

    A table must only be appended to while a stream follows it.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"files": len(files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Group(file, None) for file in files(self.path)[start["files"] : end["files"]]]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        yield from pq.ParquetFile(partition.file, filesystem=_opened(self.path)[0]).iter_batches()

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Makes the format ``committed`` known, with filters pushed down to sources in Python."""
    spark.dataSource.register(CommittedTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large old lines by a source in Python over the given table, its filters pushed down to row groups."""
    register(spark)
    line = spark.read.format("committed").option("path", f"{sf_dir}/lineitem.parquet").load()
    kept = line.where((F.col("l_quantity") > 45) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by a sink in Python in two commits, and read back with a filter."""
    register(spark)
    orders, path = table(spark, sf_dir, "orders"), new_place(spark, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    for part in (orders.where(urgent), orders.where(~urgent)):
        part.repartition(4).sortWithinPartitions("o_orderdate").write.format("committed").option("path", path).mode("append").save()
    back = spark.read.format("committed").option("path", path).load()
    return back.where(F.col("o_totalprice") > 100000).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")


QUERIES = {f"source_{f.__name__}": f for f in (custom, committed)}
ORACLE_SQL = {
    "source_custom": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
        WHERE l_quantity > 45 AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL""",
    "source_committed": "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 100000",
}
