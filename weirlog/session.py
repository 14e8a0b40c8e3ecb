"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side of at most this many rows is broadcast; a larger one is joined by shuffle,
# where adaptive execution splits skewed keys.
BROADCAST_ROWS = 1_000_000
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cpus: int | str = "*", name: str = "weirlog") -> SparkSession:
    """Local session for tests and the benchmark. On a cluster, bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """Months and event times are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where none is set and the session is a local one (tests) is a temporary folder used instead; on a
    cluster its executors and driver would each see a folder of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="weirlog-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever written to it twice."""
    return f"{shared_dir(spark)}/weirlog-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside remove their shuffle files as soon as they have run; otherwise the files stay until the
    driver happens to collect its garbage. Meant for what runs once and is stored."""
    before = spark.conf.get(SHORT_SHUFFLES, "false")
    spark.conf.set(SHORT_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHORT_SHUFFLES, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    with short_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def store(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table at ``path`` and read it from there."""
    with short_shuffles(df.sparkSession):
        df.select("*").write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for tables that are removed at the end: by then, all that is made of them must be stored elsewhere."""
    root = scratch(spark, name)
    yield root
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_lookup(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``big`` to a lookup table that is expected to be small.

    ``small`` is computed once and counted. It is broadcast only when the count is within
    ``max_rows``; otherwise the join shuffles and is left to adaptive skew handling.
    """
    small = settle(small)
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
