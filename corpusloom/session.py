"""Session helpers: a tuned local session, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "corpusloom", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects of a cluster (AQE on, UTC, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where the setting is absent, a temporary one in a local session, and an error on a cluster."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(set_dir)
        return set_dir.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpusloom-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


#: Tables written and not yet released, of all sessions of this driver.
_TABLES: list[tuple[SparkSession, str]] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by :func:`release` or when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom-tables/{name}-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write *df* once as Parquet into the shared folder and read it back.

    The files outlive lost executors. They stay until the caller is done with
    what was made of them (see :func:`scratch`) or the driver ends.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Releases, at its end, the tables written within: ``with scratch(): search(...).write.parquet(out)``."""
    before = len(_TABLES)
    try:
        yield
    finally:
        release(before)


def release(since: int = 0) -> None:
    """Remove written tables; frames made of them can no longer be read."""
    while len(_TABLES) > since:
        _remove(*_TABLES.pop())


atexit.register(release)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder's owner cleans it then
        pass
