"""Stores of facts, vectors, nodes and edges behind one Python data source, read in batch or as a stream.

A kind is a protocol: a fixed schema that every table must offer (``missing_columns``), with the columns by which rows lie
together. ``append`` writes a commit, a numbered folder of Parquet files: rows in buckets of the CRC32 of the namespace, in
ranges of the order columns within, so that a hot namespace is in many files and statistics of row groups are tight. A commit counts once
its ``_SUCCESS`` is there and all before it count; a lost writer leaves nothing that a reader sees.

Filters that Spark pushes become folders (equality or membership of the namespace) and Arrow expressions that skip row groups;
null comparisons, floats and what isn't a comparison stay with Spark. The planner lists folders and opens no file; a
partition is a slice of the row groups of a file, about ``SLICE`` bytes each. The API prunes no columns, so ``read`` takes
their names.

Defined results: a null namespace has the bucket of an empty text and stays null; an empty table is a commit without rows;
further columns of a table aren't stored; rows that repeat are all kept; a path without commits gives no rows.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

from tempofact.schemas import EDGE, MEMORY, NODE, missing_columns
from tempofact.session import ship

NAME, BUCKETS, SLICE, BATCH = "tempofact", 64, 128 << 20, 1024
#: Schema of a kind, and the columns that order its rows within a bucket.
KINDS = {
    "facts": (MEMORY, ("t_created", "id")), "vectors": ("vec_id bigint, namespace string, embedding array<float>", ("vec_id",)),
    "nodes": (NODE, ("key",)), "edges": (EDGE, ("src", "dst")),
}
COMPARISONS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
COMPARED = (T.StringType, T.LongType, T.IntegerType, T.TimestampNTZType)


def bucket_of(namespace: str | None) -> int:
    return crc32((namespace or "").encode()) % BUCKETS


def place(path: str):  # noqa: ANN201
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def committed(path: str) -> list[str]:
    """Folders of the commits that count, in order."""
    from pyarrow import fs

    files, inside = place(path)
    entries = files.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    named = {int(e.base_name[7:]): e.path for e in entries if e.base_name.startswith("commit-") and e.base_name[7:].isdigit()}
    out: list[str] = []
    while len(out) in named and files.get_file_info(f"{named[len(out)]}/_SUCCESS").is_file:
        out.append(named[len(out)])
    return out


class Slice(InputPartition):
    """Row groups ``part``, ``part + parts``, ... of a file."""

    def __init__(self, file: str, part: int, parts: int):
        self.file, self.part, self.parts = file, part, parts


def slices(path: str, commits: list[str], buckets: set[int] | None = None) -> list[Slice]:
    from pyarrow import fs

    files, _ = place(path)
    out = []
    for c in commits:
        for e in files.get_file_info(fs.FileSelector(c, recursive=True)):
            if e.is_file and e.extension == "parquet":
                folder = e.path.rsplit("/", 2)[1]
                if buckets is None or not folder.startswith("bucket=") or int(folder[7:]) in buckets:
                    n = max(1, -(-e.size // SLICE))
                    out += [Slice(e.path, k, n) for k in range(n)]
    return out


def expression(tests: list[tuple[str, str, object]]):  # noqa: ANN201
    """One Arrow expression of (operation, column, value), or none."""
    import pyarrow.compute as pc

    def one(op: str, column: str, value: object):  # noqa: ANN202
        c = pc.field(column)
        if op == "in":
            return c.isin(list(value))
        if op in ("null", "known"):
            return c.is_null() if op == "null" else c.is_valid()
        return pc.starts_with(c, value) if op == "starts" else getattr(operator, op)(c, value)

    return reduce(operator.and_, [one(*t) for t in tests]) if tests else None


def rows_of(path: str, s: Slice, names: list[str], tests: list[tuple[str, str, object]]) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds

    files, _ = place(path)
    form = ds.ParquetFileFormat()
    whole = form.make_fragment(s.file, filesystem=files)
    groups = list(range(s.part, whole.num_row_groups, s.parts))
    if groups:
        some = form.make_fragment(s.file, filesystem=files, row_groups=groups)
        for b in some.to_batches(columns=names, filter=expression(tests), batch_size=BATCH, batch_readahead=1, fragment_readahead=1, use_threads=False):
            if b.num_rows:
                yield b


class StoreReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.tests, self.buckets = path, schema, [], None

    def test_of(self, f: Filter) -> tuple[str, str, object] | None:
        """(operation, column, value) of a filter that files can answer exactly."""
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in self.schema.names:
            return None
        if isinstance(f, (IsNull, IsNotNull)):
            return ("null" if isinstance(f, IsNull) else "known", column[0], None)
        if not isinstance(self.schema[column[0]].dataType, COMPARED):
            return None
        if isinstance(f, In):
            return ("in", column[0], tuple(f.value)) if all(v is not None for v in f.value) else None
        if isinstance(f, StringStartsWith):
            return ("starts", column[0], f.value)
        return (COMPARISONS[type(f)], column[0], f.value) if type(f) in COMPARISONS and f.value is not None else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            test = self.test_of(f)
            if test is None:
                yield f
                continue
            self.tests.append(test)
            if test[1] == "namespace" and test[0] in ("eq", "in"):
                named = {bucket_of(v) for v in (test[2] if test[0] == "in" else [test[2]])}
                self.buckets = named if self.buckets is None else self.buckets & named

    def partitions(self) -> list[Slice]:
        return slices(self.path, committed(self.path), self.buckets) or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from rows_of(self.path, partition, self.schema.names, self.tests)


class StoreStream(DataSourceStreamReader):
    """Offsets are numbers of commits; a batch is what was committed since."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commits": len(committed(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(self.path, committed(self.path)[start["commits"] : end["commits"]])

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.path, partition, self.schema.names, [])


class Store(DataSource):
    """Options: path, kind (facts, vectors, nodes, edges) and columns (comma-separated, all unless given)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        every = dict(c.split(" ", 1) for c in KINDS[self.options.get("kind", "facts")][0].split(", "))
        names = [n.strip() for n in self.options.get("columns", "").split(",") if n.strip()]
        return ", ".join(f"{n} {every[n]}" for n in names or every)

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> StoreStream:  # noqa: N802
        return StoreStream(self.options["path"], schema)


def append(df: DataFrame, path: str, kind: str = "facts") -> None:
    """Commit the rows of ``df``. Of two writers at once the second fails, for the folder is there."""
    ddl, order = KINDS[kind]
    lacking = missing_columns(df, ddl)
    if lacking:
        raise ValueError(f"not a table of {kind}: {', '.join(lacking)}")
    near = ["bucket", *order]
    rows = df.select(*T.StructType.fromDDL(ddl).names, (F.crc32(F.coalesce("namespace", F.lit("")).cast("binary")) % BUCKETS).cast("int").alias("bucket"))
    laid = rows.repartitionByRange(*near).sortWithinPartitions(*near)
    laid.write.partitionBy("bucket").parquet(f"{path}/commit-{len(committed(path)):08d}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Store)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, kind: str = "facts", columns: Iterable[str] = ()) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(path=path, kind=kind, columns=",".join(columns)).load()


def read_stream(spark: SparkSession, path: str, kind: str = "facts", columns: Iterable[str] = ()) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(path=path, kind=kind, columns=",".join(columns)).load()


ship(__name__)
