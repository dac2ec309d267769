"""Log objects: one text object ``<run id>.txt`` per run, which grows while the run goes on.

No Spark source reads a file from an offset, so the appended parts are read inside tasks with
``pyarrow.fs``, in ranges of at most ``RANGE_BYTES``: a long part is shared among tasks and no
task holds more than a range and its last line. Folders are listed inside tasks too: objects
are as many as the runs, and Spark's sources list files through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.session import scratch_path

RANGE_BYTES = 8 << 20
SUFFIX = ".txt"
_STEP = 1 << 16
LINES = "object string, run_id string, range_no bigint, pos bigint, raw string, end_byte bigint, lines_read bigint"
LISTED = "path string, size bigint, is_folder boolean"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file URI (``file:/x`` and plain paths too)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def tasks(spark: SparkSession) -> int:
    """How many tasks share work that is counted in files: adaptive execution sees bytes only,
    and would leave a short table of many files to one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sub_folder(name: str, folders: int) -> str:
    """The folder, with a slash, of a name dealt to ``folders`` folders; none where there is one."""
    return f"dealt={zlib.crc32(name.encode()) % folders:04d}/" if folders > 1 else ""


def _hidden(name: str) -> bool:
    """Names that Spark's sources do not list either."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, root = opened(uri)
            start = "file:" if isinstance(store, fs.LocalFileSystem) else uri[:len(uri) - len(root)]
            here = store.get_file_info(root)
            found = [here] if here.is_file else store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            found = [f for f in found if not _hidden(f.base_name)]
            for i in range(0, len(found), 10_000):
                part = found[i:i + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start + f.path for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()),
                     pa.array([not f.is_file for f in part], pa.bool_())], ["path", "size", "is_folder"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """files(path, size) below ``path`` at any depth; contents are not read. A task lists a
    folder, level by level; each level is written, so that files are listed once and the driver
    holds none of them."""
    store, root = opened(path.rstrip("/"))
    if store.get_file_info(root).type == fs.FileType.NotFound:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
    here, found = spark.createDataFrame([(path.rstrip("/"),)], "path string"), None
    while True:
        kept = scratch_path(spark, "listing")
        here.repartition(tasks(spark), "path").mapInArrow(_listed, LISTED).write.parquet(kept)
        level = spark.read.schema(LISTED).parquet(kept)
        files = level.filter("not is_folder").select("path", "size")
        found = files if found is None else found.unionByName(files)
        here = level.filter("is_folder").select("path")
        if here.isEmpty():
            return found


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """objects(object, run_id, size) of the text objects below ``path``; contents are not read."""
    files = list_files(spark, path).withColumn("__name", F.substring_index("path", "/", -1))
    return files.filter(F.col("__name").endswith(SUFFIX)).select(
        F.col("path").alias("object"), F.regexp_extract("__name", r"^(.*)\.txt$", 1).alias("run_id"), "size")


def write_log_objects(lines: DataFrame, path: str, folders: int = 1) -> None:
    """log_lines(run_id, line_no, raw) as objects, each run's lines closed by line ends; an
    object of the same name is replaced. An object is one file, written line by line by one task.
    Lines without a run id make the object ``.txt``. With more than one of ``folders`` the
    objects are dealt to so many below ``path``, which tasks can then list."""
    def place(run: str, _: int) -> tuple[str, str]:
        return sub_folder(run, folders), f"{run}{SUFFIX}"

    rows = lines.select(F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("run_id"), "line_no", "raw")
    rows = rows.repartition(tasks(lines.sparkSession), "run_id").sortWithinPartitions("run_id", "line_no")
    write_runs(rows.select("run_id", "raw"), path, place)


def write_runs(rows: DataFrame, path: str, place: Callable[[str | None, int], tuple[str, str]]) -> None:
    """Each task's rows (run_id, raw), a run's next to each other, as files of a line each row:
    ``place`` gives the folder below ``path`` (empty or with a slash) and the name of a run's
    file in a task. Files are seen whole; a task done again leaves the same ones."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path.rstrip("/"))
        store.create_dir(root, recursive=True)
        task, made = TaskContext.get(), {""}
        out, at, n, moved = None, ("", ""), 0, 0
        hidden = lambda: f"{root}/{at[0]}.{at[1]}.{task.taskAttemptId()}.tmp"

        def close() -> int:
            if out is None:
                return 0
            out.close()
            store.move(hidden(), f"{root}/{at[0]}{at[1]}")
            return 1

        for batch in batches:
            runs, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i = 0
            while i < len(runs):
                stop = i + 1
                while stop < len(runs) and runs[stop] == runs[i]:
                    stop += 1
                if out is None or place(runs[i], task.partitionId()) != at:  # runs may share a place
                    moved += close()
                    at = place(runs[i], task.partitionId())
                    if at[0] not in made:
                        store.create_dir(f"{root}/{at[0]}", recursive=True)
                        if len(made) < 10_000:
                            made.add(at[0])
                    out = store.open_output_stream(hidden())
                out.write("".join([f"{raw or ''}\n" for raw in raws[i:stop]]).encode())
                i = stop
            n += len(runs)
        moved += close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([moved], pa.int64())], ["lines", "objects"])

    rows.mapInArrow(write, "lines bigint, objects bigint").agg(F.sum("lines")).collect()


def _lines_of(uri: str, first: int, start: int, stop: int, size: int, take_last: bool) -> Iterator[tuple[str, int]]:
    """(line, byte after its line end) of the lines that begin in [start, stop); ``first`` is
    where the unread part begins. The last line counts without a line end only if ``take_last``."""
    store, path = opened(uri)
    with store.open_input_file(path) as src:
        at = start
        if start > first:  # the line that reaches into this range belongs to the range before
            at = start - 1
            src.seek(at)
            while True:
                block = src.read(min(_STEP, size - at))
                if not block:
                    return
                cut = block.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(block)
        src.seek(at)
        held, begin, base = b"", 0, at  # ``held`` begins at byte ``base``, the open line at ``begin`` in it
        while base + begin < stop:
            cut = held.find(b"\n", begin)
            if cut >= 0:
                yield held[begin:cut].decode("utf-8", "replace"), base + cut + 1
                begin = cut + 1
                continue
            block = src.read(min(_STEP, size - base - len(held)))
            if not block:
                if begin < len(held) and take_last:
                    yield held[begin:].decode("utf-8", "replace"), base + len(held)
                return
            held, base, begin = held[begin:] + block, base + begin, 0


def read_ranges(parts: DataFrame, any_line_end: bool = False) -> DataFrame:
    """Lines of the unread parts(object, run_id, bytes_read, lines_read, size, finished): object,
    run_id, range_no, pos (place in the range), raw, end_byte (the byte after the line) and the
    part's lines_read. ``any_line_end``: a carriage return ends a line too, as Spark's text
    source has it."""
    ranges = parts.select("object", "run_id", "bytes_read", "size", "finished", "lines_read",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - bytes_read - 1) div {RANGE_BYTES}"))).alias("range_no"))

    width = RANGE_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["object", "run_id", "range_no", "pos", "raw", "end_byte", "lines_read"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        held = []
        for batch in batches:
            for uri, run, first, size, finished, before, nth in zip(*(c.to_pylist() for c in batch.columns)):
                start, pos = first + nth * width, 0
                for line, end in _lines_of(uri, first, start, min(start + width, size), size, bool(finished)):
                    for piece in line.removesuffix("\r").split("\r") if any_line_end and "\r" in line else (line,):
                        held.append((uri, run, nth, pos, piece, end, before))
                        pos += 1
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return ranges.repartition(tasks(parts.sparkSession), "object", "range_no").mapInArrow(read, LINES)
