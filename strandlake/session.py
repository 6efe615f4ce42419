"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own. Python workers find the package by PYTHONPATH."""
    root = str(Path(__file__).resolve().parents[1])
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (root, os.environ.get("PYTHONPATH", "")) if p)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder for the life of the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="strandlake-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path under the shared folder; inside ``temporary`` it goes in the end unless it is to ``keep``."""
    path = f"{shared_dir(spark)}/strandlake-{label}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    else:
        _staged.append(path)
    return path


_scopes: list[list[str]] = []
#: What results may still read; ``forget_staged`` deletes it.
_staged: list[str] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_staged(spark: SparkSession) -> int:
    """Deletes all that this session has staged; call it once no result is read any more. Returns how many folders went."""
    paths = [p for name in _staged for p in (name, f"{name}-state")]
    n = len(_staged)
    _staged.clear()
    _delete(spark, paths)
    return n


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes what is staged inside when it ends, but for what is staged with ``keep``: for steps whose result no longer reads their tables."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        _delete(spark, made)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")
