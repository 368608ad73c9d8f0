"""Session helpers: configuration, the package on the executors, table loading, and where cut lineage is stored."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Set only where the submit has not: dates are UTC, plans adapt.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()
_local: dict[str, str] = {}
_open = threading.local()


def get_session(cores: str | None = None, app: str = "tidewire") -> SparkSession:
    """The session of the submit, with what it leaves open. ``cores`` asks for a local one, as tests and bench do."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config(
            "spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in DEFAULTS.items():
        if key not in given:
            spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidewire-")), "tidewire-package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(home)))
        context.addPyFile(archive)  # Spark's own file server hands it out
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master, where the driver is the one executor, may go without: it gets a folder for the application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tidewire-")
    return _local[app]


def _steps(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/steps-{spark.sparkContext.applicationId}"


def step_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, below the one folder of this application."""
    path = f"{_steps(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_open, "scratches", [])[-1:]:
        paths.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_steps(spark: SparkSession) -> None:
    """Delete what this application has stored; results that still read it must have been written."""
    _delete(spark, _steps(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Steps that this thread stores inside the block are deleted at its end, also after an error.

    A result has to be written inside the block, to a ``step_path`` taken before it.
    """
    if not hasattr(_open, "scratches"):
        _open.scratches = []
    _open.scratches.append([])
    try:
        yield
    finally:
        for path in _open.scratches.pop():
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
            _delete(spark, path)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins real table sizes.
    """
    spark = df.sparkSession
    path = step_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def materialize_bucketed(df: DataFrame, name: str, column: str, buckets: int, **options: object) -> DataFrame:
    """``materialize`` as a table in ``buckets`` buckets of ``column``: what is joined to it by that column travels, it stays."""
    path = step_path(df.sparkSession, name)
    df.write.bucketBy(buckets, column).options(**options).option("path", path).saveAsTable(_table_name(path))
    return df.sparkSession.table(_table_name(path))


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Workers get rows of texts in batches of about ``size`` bytes, for steps that are stored inside the block."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; zone-less timestamps become UTC instants once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df
