"""Session helpers: a tuned local session, shared scratch space, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "popweave", cores: int | str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster must
    name a folder that every executor can reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("popweave.local.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="popweave-")
    spark.conf.set("popweave.local.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/popweave/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, ends the lineage of iterative
    jobs, keeps column pruning and gives Catalyst real sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder below the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def case_sensitive(spark: SparkSession) -> SparkSession:
    """A session with the same settings that tells column names apart by case; the given one keeps ignoring it."""
    other = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) or name.startswith("popweave."):
            other.conf.set(name, value)
    other.conf.set("spark.sql.caseSensitive", "true")
    return other


def spread(spark: SparkSession) -> int:
    """How many pieces a hot group is split into: a few per shuffle partition."""
    fixed = spark.conf.get("popweave.spread", None)
    if fixed:
        return int(fixed)
    return max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def constant_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A short fixed table as a literal relation (no Python workers, known size)."""
    def text(v):
        return "NULL" if v is None else "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
