"""Session helpers shared by every operator: code shipping, shared storage, size checks."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_marked: set[str] = set()
#: What else to forget when the working tables go.
on_drop: list[Callable[[], None]] = []
#: Bytes of rows that a join may broadcast.
MAX_BROADCAST = 128 << 20


def local_session(cpus: int | str = 8, memory: str = "12g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexweave-ship-")  # driver side only; Spark copies it to executors
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"lexweave_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("lexweave") / p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is spark.checkpoint.dir of the session. Only a local master may leave it
    unset (tests, a single machine): then a folder of our own is made and removed
    at exit. On a cluster a machine's own folder would lose rows without a word.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="lexweave-shared-")
        atexit.register(shutil.rmtree, folder, True)
        _own_dirs[app] = f"file://{folder}"
    return _own_dirs[app]


def _work(spark: SparkSession) -> tuple[str, Any, Any]:
    """This application's folder for working tables, as text, Hadoop path and file system."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/lexweave/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return folder, path, path.getFileSystem(sc._jsc.hadoopConfiguration())


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    folder, path, fs = _work(spark)
    if folder not in _marked:
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def drop_working_tables(spark: SparkSession) -> None:
    """Delete all working tables of this application; frames that still read them are void."""
    folder, path, fs = _work(spark)
    _marked.discard(folder)
    fs.delete(path, True)
    for forget in on_drop:
        forget()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    A lost executor then costs a reread, not a recomputation, and later jobs
    start from the written rows.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, width: int = 64, most: int = MAX_BROADCAST) -> DataFrame:
    """Mark a table for broadcast only when its counted rows, of ``width`` bytes each, are within ``most`` bytes.

    Beyond that the table is returned as it is, and the join shuffles.
    """
    return F.broadcast(df) if rows * width <= most else df
