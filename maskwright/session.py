"""Session helpers shared by the queries."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, whatever their working folder is."""
    app = spark.sparkContext.applicationId
    with _shipping:
        if app not in _shipped:
            _ship(spark)
            _shipped.add(app)


def _ship(spark: SparkSession) -> None:
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="maskwright-")) / "maskwright.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session; in a temporary one where none is configured and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/maskwright/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames made and run inside go when they end, not when the driver's memory is cleared some time later."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder of the session and read back, so that steps don't pile up in the plan and survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_dropped(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(*frames: DataFrame) -> None:
    """Delete what settled wrote for these frames; nothing may read them any more."""
    for df in frames:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = hadoop.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What is broadcast has no more rows and bytes than that.
SMALL_ROWS, SMALL_BYTES = 500_000, 64 << 20


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Do its rows and bytes, which are counted, allow a broadcast?"""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return got.n <= rows and got.b <= size


def if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """The frame, to be broadcast if it is small."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
