"""Helpers shared by the training-data operators.

``identified`` gives every row an identity that does not depend on how a scan
is split into tasks, so a lost executor or a changed executor count cannot
renumber rows; ``stored`` writes a table into the shared folder and reads it
back, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.session import ensure_checkpoint_dir, scratch_path

ROW_ID = ("rid_file", "rid_row")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_files(df: DataFrame) -> DataFrame:
    """``df`` if its rows have a place in files, else a stored copy, whose rows have."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  resolve now
        return df
    except AnalysisException:
        return stored(df, "rows")


def identified(df: DataFrame, *columns: str) -> DataFrame:
    """``rid_file, rid_row`` (hash of the file, row in the file) and the named columns;
    without names, ``row``: a struct of all columns, whatever they are called."""
    df = on_files(df)
    meta = df.metadataColumn("_metadata")
    rest = [df[c] for c in columns] or [F.struct(*[df[c] for c in df.columns]).alias("row")]
    return df.select(F.xxhash64(meta["file_path"]).alias(ROW_ID[0]), meta["row_index"].alias(ROW_ID[1]), *rest)


def only_rows(df: DataFrame, rids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` (read from files) whose identity is among ``rids``, all columns;
    with ``left_anti`` the others."""
    return identified(df).join(rids.select(*ROW_ID), [*ROW_ID], how).select("row.*")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``limit`` bytes of ``text``
    (one row at least): the Python side's memory follows the longest text, not
    the batch's row count."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            yield batch
            continue
        import pyarrow.compute as pc
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their column ``text`` compressed (null as empty), for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches, "text"):
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array([pack(t) for t in raw(batch.column(at))], pa.binary()))


def expanded(column: pa.Array) -> list[bytes]:
    """The texts of a column that ``squeezed`` made."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(b) for b in column.to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
