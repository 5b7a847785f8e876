"""Session helpers shared by the bench, the tests and the registered queries."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The scratch spaces that are open, each the paths of its tables; the last is the innermost.
_SPACES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("spaces", default=())


def local_session(cores: int | str = 8, app: str = "postsift", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that iterative operators cut their lineage into.

    A cluster names it in ``spark.checkpoint.dir`` (or calls ``setCheckpointDir``);
    without either this is an error there. Only a session in one local process, as
    in tests, gets a folder of its own, since all its tasks see it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postsift-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it as a plain scan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the table as read back.

    This cuts the lineage: a lost executor costs its running tasks only. The shuffles that made
    the table are removed as soon as it is written, not when the driver next collects garbage. The table
    goes with the innermost :func:`scratch_space`, or if it is ``lasting`` with the one around that.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    if spaces := _SPACES.get()[: -1 if lasting else None]:
        spaces[-1].append(path)
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Tables that are :func:`stored` inside are deleted at the end, unless they are ``lasting``."""
    made: list[str] = []
    token = _SPACES.set((*_SPACES.get(), made))
    try:
        yield
    finally:
        _SPACES.reset(token)
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a part of an input that has fewer splits than cores.

    Does nothing to an input that already has enough splits, so a large table is
    never shuffled for this. The key makes the parts the same on every attempt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
