"""Session helpers shared by the operators: staged tables, worker import path, text column reading."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.sources.paths import shared_dir

_shipped: set[str] = set()
#: Tables staged inside each open ``scratch``, the innermost last.
_scratch: list[list[DataFrame]] = []


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether Spark deletes a query's shuffle files as it ends, instead of once the driver happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession, batch_rows: int = 2000) -> None:
    """Let Python workers import this package: by path on a local master, as a file that Spark hands out elsewhere. They
    get ``batch_rows`` rows at a time at most: texts are long."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= batch_rows:
        spark.conf.set(BATCH_ROWS, batch_rows)
    if sc.master.startswith("local["):
        root = str(package.parent)
        if root not in sc.environment.get("PYTHONPATH", "").split(":"):
            sc.environment["PYTHONPATH"] = ":".join(filter(None, [root, sc.environment.get("PYTHONPATH")]))
    elif sc.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, lost executors don't matter, and the
    shuffle files of the write, which nothing reads again, go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm, path = df.sparkSession.sparkContext._jvm, df.staged_path
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch() -> Iterator:
    """Tables staged inside are deleted at the end, but for those given to what this yields. Shuffle files of the steps
    inside go too: Spark deletes them once the driver has collected the plans that made them."""
    own: list[DataFrame] = []
    _scratch.append(own)
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scratch.pop()
        paths = {df.staged_path for df in kept}
        for df in own:
            if df.staged_path not in paths:
                dropped(df)
            elif _scratch:
                _scratch[-1].append(df)
        if own:
            gc.collect()
            own[0].sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, n: int):
    """crc32(id as text) mod n."""
    return F.pmod(F.crc32(F.encode(F.col(col).cast("string"), "utf-8")), F.lit(n))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` (of narrow rows) marked for broadcast if it has at most ``rows`` rows, else as it is: then it's shuffled."""
    return F.broadcast(df) if small_enough(df, rows) else df
