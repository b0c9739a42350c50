"""Session helpers shared by every subpackage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "netloom", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, through Spark's reader only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests, benchmarks) gets a temporary
    folder; a cluster has no folder that all machines see, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the copy outlives executors, and unlike an RDD
    checkpoint it is columnar, so that later reads prune columns. ``discard``
    deletes the copy; what is left goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._netloom_path = path
    _left[path] = spark
    return copy


class Levels:
    """Tables of equal schema written one after the other into a folder each, and read together with their number."""

    def __init__(self, spark: SparkSession, number: str):
        self.spark, self.number, self.path, self.schema = spark, number, f"{shared_dir(spark)}/netloom-{uuid.uuid4().hex}", None
        _left[self.path] = spark

    def write(self, df: DataFrame, k: int) -> DataFrame:
        self.schema = df.schema
        df.write.parquet(f"{self.path}/{self.number}={k}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.number}={k}")

    def read(self) -> DataFrame:
        """All tables with a bigint column for their number: one scan, however many there are."""
        types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields), f"`{self.number}` bigint"])
        copy = self.spark.read.schema(types).option("basePath", self.path).parquet(self.path)
        copy._netloom_path = self.path
        return copy


def discard(*frames: DataFrame) -> None:
    """Delete the copies behind frames of ``materialize``; nothing that is still to be read may depend on them."""
    for df in frames:
        if path := getattr(df, "_netloom_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Copies that nothing has deleted yet.
_left: dict[str, SparkSession] = {}


@atexit.register
def _tidy() -> None:
    for path, spark in list(_left.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)
