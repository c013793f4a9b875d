"""Session, checkpoint folder and materialisation helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("civictally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only on a local master (tests, a laptop), where ``spark.checkpoint.dir`` is unset and no
    checkpoint folder was chosen, a temporary one is made; on a cluster that is an error, as each
    executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    chosen = sc._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not is_local(sc.master):
        raise ValueError(f"spark.checkpoint.dir is not set: on {sc.master} it must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="civictally-"))
    return sc._jsc.sc().getCheckpointDir().get()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder as a compressed table and read from there. A lazily read result
    may need it, so it stays until ``drop_stored``."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    _folders(spark).append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_stored(spark: SparkSession, df: DataFrame | None = None) -> None:
    """Delete one stored table, or all that this session stored and that no result needs any more."""
    folders = _folders(spark)
    gone = list(folders)
    if df is not None:
        read = df.inputFiles()
        gone = [f for f in folders if any(f.rsplit("/", 1)[1] in x for x in read)]
    for folder in gone:
        remove_path(spark, folder)
        folders.remove(folder)


def _folders(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "civictally_stored"):
        sc.civictally_stored = []
    return sc.civictally_stored


def remove_path(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared storage, whatever its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "civictally_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="civictally-")) / "civictally.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc.civictally_shipped = True
