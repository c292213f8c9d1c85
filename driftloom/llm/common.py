"""Shared helpers: reading tables, shared-folder tables, Arrow batch iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_column(id_col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def unused(columns: list[str], stem: str) -> str:
    """A prefix that begins no column's name, in either case."""
    while any(c.lower().startswith(stem) for c in columns):
        stem = "_" + stem
    return stem


def quoted(name: str):
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


@lru_cache(maxsize=1)
def own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="driftloom-")


OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, every table that operators wrote inside it: write or collect their results inside, too."""
    paths: list[str] = []
    token = OPEN.set(paths)
    try:
        yield
    finally:
        OPEN.reset(token)
        for path in paths:
            delete_dir(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees; where that is unset, a temp folder if all runs on
    this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = own_dir()
    path = f"{base.rstrip('/')}/driftloom/{uuid.uuid4().hex}"
    if (paths := OPEN.get()) is not None:
        paths.append(path)
    return path


def delete_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: computed once, lineage cut, safe if executors are lost."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._driftloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by ``written``."""
    delete_dir(df.sparkSession, df._driftloom_path)


def map_rows(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for columns of any name, dots included."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x if x is not None else b"" for x in col.to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most about ``limit`` bytes of text (a longer text comes alone)."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        col = b.column(b.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col.cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, s in enumerate(sizes.tolist()):
            if i > start and total + s > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += s
        yield b.slice(start)


def join_hot(rows: DataFrame, table: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``n`` how many of ``rows`` hold it (at most).  Keys
    of more than ``most`` rows, of which there are at most sum(n) / most, are broadcast, so none of them fills one task; the
    others meet in a shuffle.  ``rows`` is read twice: pass a table."""
    hot, cold = table.where(F.col("n") > most).drop("n"), table.where(F.col("n") <= most).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
