"""Motion files as a Spark data source, ``spark.read.format("motion_csv")``: tasks read the files' own headers; writes become visible as a whole or not at all."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pa_csv
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stridelake.sources.motion_files import LAYOUTS, ROOT, SKIPPED

#: Bytes of files that a task reads (about), and of a block of a file in memory.
TASK_BYTES, BLOCK_BYTES = 128 << 20, 8 << 20
NAME = "motion_csv"


def opened(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without scheme is local."""
    if "://" not in path and path.startswith("file:"):
        path = f"file://{path[5:]}"
    if "://" not in path:
        return pa_fs.LocalFileSystem(), path.rstrip("/")
    system, inner = pa_fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def motion_schema(columns: list[str]) -> T.StructType:
    """Frame and the columns, then ``rel_path``: numbers of roots and joints, text otherwise."""
    kind = lambda c: T.LongType() if c == "Frame" else T.DoubleType() if c in ROOT or c.endswith("_dof") else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns] + [T.StructField("rel_path", T.StringType())])


@dataclass
class Files(InputPartition):
    """Files of one task: path and path below the source's folder."""

    files: list[tuple[str, str]]


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its folder under a temporary name, and under its final one."""

    temporary: str
    name: str
    files: int
    rows: int


def visible_files(system: pa_fs.FileSystem, folder: str) -> Iterator[tuple[str, str, int]]:
    """``(path, path below the folder, size)`` of the motion files. Where runs have left manifests, files of the parts these name are visible alone; names that begin with _ or . never are."""
    kept = None
    if system.get_file_info(f"{folder}/_manifest").type == pa_fs.FileType.Directory:
        kept = set()
        for m in system.get_file_info(pa_fs.FileSelector(f"{folder}/_manifest")):
            if m.base_name.endswith(".json") and not m.base_name.startswith("."):
                with system.open_input_stream(m.path) as f:
                    kept.update(json.loads(f.read())["parts"])
    if system.get_file_info(folder).type == pa_fs.FileType.NotFound:
        return
    for info in system.get_file_info(pa_fs.FileSelector(folder, recursive=True)):
        below = info.path[len(folder) + 1 :]
        names = below.split("/")
        if info.type != pa_fs.FileType.File or not below.endswith(".csv") or names[-1] in SKIPPED or any(n[0] in "_." for n in names):
            continue
        if kept is None or names[0] in kept:
            yield info.path, below if kept is None else "/".join(names[1:]), info.size


class MotionReader(DataSourceReader):
    """A task reads its files one after the other in blocks of bounded size: columns by each file's own header, those of the schema alone."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.size = schema, options["path"], int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, folder = opened(self.path)
        out, held, size = [], [], 0
        for path, below, length in sorted(visible_files(system, folder)):
            if held and size + length > self.size:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, below))
            size += length
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        kinds = {"bigint": pa.int64(), "double": pa.float64()}
        types = {f.name: kinds.get(f.dataType.simpleString(), pa.string()) for f in self.schema.fields}
        for path, below in partition.files:
            with system.open_input_stream(path) as f:
                head = b""
                while b"\n" not in head and (more := f.read(1 << 16)):
                    head += more
            header = [c.strip() for c in next(csv.reader(io.StringIO(head.split(b"\n", 1)[0].decode())), [])]
            if not any(header):
                continue
            if missing := sorted(set(ROOT) - set(header)):
                raise ValueError(f"columns {missing} are missing in {path}")
            wanted = [c for c in types if c in header]
            convert = pa_csv.ConvertOptions(include_columns=wanted, column_types={c: types[c] for c in wanted}, null_values=[""], strings_can_be_null=True)
            with system.open_input_stream(path) as f:
                for batch in pa_csv.open_csv(f, pa_csv.ReadOptions(block_size=BLOCK_BYTES, column_names=header, skip_rows=1), convert_options=convert):
                    n = batch.num_rows
                    columns = [batch.column(c) if c in wanted else pa.array([below] * n) if c == "rel_path" else pa.nulls(n, t) for c, t in types.items()]
                    yield pa.RecordBatch.from_arrays(columns, names=list(types))


class MotionWriter(DataSourceArrowWriter):
    """A file per motion. Tasks write into temporary folders; the commit gives these their names and then the run its manifest, which makes them visible; an abort removes them."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.columns, self.path, self.overwrite, self.run = [f.name for f in schema.fields], options["path"], overwrite, uuid.uuid4().hex
        if "rel_path" not in self.columns or "Frame" not in self.columns:
            raise ValueError("motion files need the columns rel_path and Frame")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = opened(self.path)
        name = f"part-{uuid.uuid4().hex}"
        temporary = f"{folder}/_temporary/{self.run}/{name}"
        system.create_dir(temporary, recursive=True)
        written, rows, current, sink, out = set(), 0, None, None, None
        own = [c for c in self.columns if c != "rel_path"]
        try:
            for batch in iterator:
                paths = batch.column(self.columns.index("rel_path")).to_pylist()
                table = batch.select(own)
                at = 0
                while at < len(paths):
                    end = at
                    while end < len(paths) and paths[end] == paths[at]:
                        end += 1
                    if paths[at] != current:
                        if sink is not None:
                            out.close(), sink.close()
                        current = paths[at]
                        if not current or current.startswith("/") or ".." in current.split("/") or current in written:
                            raise ValueError(f"{current!r} is no path of a motion, or its rows don't stand together")
                        written.add(current)
                        file = f"{temporary}/{current}"
                        system.create_dir(file.rsplit("/", 1)[0], recursive=True)
                        sink = system.open_output_stream(file)
                        sink.write((",".join(own) + "\n").encode())
                        out = pa_csv.CSVWriter(sink, table.schema, write_options=pa_csv.WriteOptions(include_header=False))
                    out.write_batch(table.slice(at, end - at))
                    rows += end - at
                    at = end
        finally:
            if sink is not None:
                out.close(), sink.close()
        return Part(temporary, name, len(written), rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = opened(self.path)
        parts = [m for m in messages if m is not None and m.files]
        older = [p.path for p in system.get_file_info(pa_fs.FileSelector(f"{folder}/_manifest", allow_not_found=True))]
        for m in parts:
            system.move(m.temporary, f"{folder}/{m.name}")
        system.create_dir(f"{folder}/_manifest", recursive=True)
        hidden = f"{folder}/_manifest/.{self.run}"
        with system.open_output_stream(hidden) as f:
            f.write(json.dumps({"parts": [m.name for m in parts], "files": sum(m.files for m in parts), "rows": sum(m.rows for m in parts)}).encode())
        system.move(hidden, f"{folder}/_manifest/{self.run}.json")
        if self.overwrite:
            for path in older:
                system.delete_file(path)
            for p in system.get_file_info(pa_fs.FileSelector(folder)):
                if p.base_name.startswith("part-") and p.base_name not in {m.name for m in parts}:
                    system.delete_dir(p.path)
        self._clean(system, folder)

    def abort(self, messages: list[Part | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, system: pa_fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_temporary/{self.run}").type == pa_fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary/{self.run}")


class MotionSource(DataSource):
    """Motion files under ``path``. Without a schema the columns are those of ``layout``, or of all known layouts; a schema of fewer columns is all that is parsed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        layout = self.options.get("layout")
        joints = LAYOUTS[layout] if layout else tuple(dict.fromkeys(c for names in LAYOUTS.values() for c in names))
        return motion_schema(["Frame", *ROOT, *joints])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MotionReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> MotionWriter:
        return MotionWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(MotionSource)


def read_motions(spark: SparkSession, path: str, columns: list[str] | None = None, layout: str | None = None) -> DataFrame:
    """Motion files of any headers, columns by name, null where a file lacks one; with ``columns`` these alone are parsed, and ``rel_path``.

    Files are listed once, their contents are read once, each by the task that needs it; the file system must be one that pyarrow opens. A file without the root's columns is an
    error, an empty one has no rows.
    """
    register(spark)
    reader = spark.read.format(NAME)
    if columns is not None:
        reader = reader.schema(motion_schema(columns))
    return (reader.option("layout", layout) if layout else reader).load(path)


def write_motions(df: DataFrame, path: str, mode: str = "append") -> None:
    """One file per ``rel_path``, frames in order. Readers see all of a run or nothing, and what a failed task has written is removed."""
    register(df.sparkSession)
    df.repartition("rel_path").sortWithinPartitions("rel_path", "Frame").write.format(NAME).mode(mode).save(path)
