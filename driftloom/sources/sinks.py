"""Writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from driftloom.schema import DISPLAY


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite", compression: str = "none", display: bool = False) -> None:
    """CSV with a header, compressed with "gzip" if wished; ``display`` uses the reports' column names."""
    if display:
        df = df.select(*[df[c].alias(DISPLAY.get(c, c)) for c in df.columns])
    df.write.mode(mode).option("header", True).option("compression", compression).csv(path)


def write_panel(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Parquet, a folder for each symbol, so that scans of few symbols read only those."""
    df.repartition("symbol").write.mode(mode).partitionBy("symbol").parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees; a temp folder where that is unset and all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp()).rstrip('/')}/files/{uuid.uuid4().hex}"
