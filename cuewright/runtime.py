"""Session helpers: reading tables, cutting lineage, name-safe columns."""

from __future__ import annotations

import atexit
import os
import shutil
import sysconfig
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they run.

    Nothing is done where it is installed or on PYTHONPATH, which workers
    share; otherwise its sources go along with the session's Python files.
    """
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    known = [sysconfig.get_paths()[k] for k in ("purelib", "platlib")] + os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(sc, "_cuewright_shipped", False) or str(root) in known:
        return
    folder = tempfile.mkdtemp(prefix="cuewright-files-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/cuewright.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "cuewright").rglob("*.py")):
            z.write(path, path.relative_to(root))
    sc.addPyFile(archive)
    sc._cuewright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; every timestamp comes as a UTC timestamp."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(f"`{field.name}`").cast("timestamp"))
    return df


def _checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder for intermediate data; it is emptied when the program ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cuewright-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    # Below the named folder Spark makes one for this session.
    own, jvm = sc.getCheckpointDir(), sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(own)
    system = path.getFileSystem(sc._jsc.hadoopConfiguration())

    def clear() -> None:
        try:
            system.delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            pass

    atexit.register(clear)


@contextmanager
def task_progress(spark: SparkSession, callback: Callable[[int, int], None] | None, seconds: float = 0.1) -> Iterator[None]:
    """Calls callback(tasks done, tasks in all) of the running stages while the block runs; None does nothing."""
    if callback is None:
        yield
        return
    over = threading.Event()

    def watch() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not over.wait(seconds):
            try:
                stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
            except Exception:  # noqa: BLE001 - the session is being stopped
                return
            live = [s for s in stages if s is not None]
            if live:
                callback(sum(s.numCompletedTasks for s in live), sum(s.numTasks for s in live))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back.

    The folder is the one the session names in spark.checkpoint.dir; only in
    local mode, where it may be unset, a private one is made.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame, label: str) -> DataFrame:
    """Like settle(), as a parquet table that keeps column pruning for later readers."""
    spark = df.sparkSession
    _checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{label}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path for files below the checkpoint folder; nothing is there yet."""
    _checkpoint_folder(spark)
    root = spark.sparkContext.getCheckpointDir()
    # Local folders come as file:/path, which other readers than Spark's don't take.
    root = "/" + root[5:].lstrip("/") if root.startswith("file:") else root
    return f"{root}/{label}-{uuid.uuid4().hex}"


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; present: {', '.join(df.columns)}")
