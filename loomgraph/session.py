"""Session settings, and the shared folder for tables that must outlive an executor."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: int = 8, name: str = "loomgraph") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, unless they are sure to find it where the driver did."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    on_path = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    at_home = sc.master.startswith("local[") and Path.cwd() == root
    if (sc.master.startswith("local") and on_path) or at_home:
        return
    if sc.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="loomgraph-code-")
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(f"{folder}/loomgraph", "zip", root, "loomgraph"))
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "loomgraph").rglob("*.py")):
            z.write(f, f.relative_to(root).as_posix())
    path = f"{app_dir(spark)}/loomgraph.zip"
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one, but only in local mode: on a cluster
    the executors would write to disks of their own, so there it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, so a lost executor
    costs nothing that was computed before. The files are removed when the application ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def app_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}"
    if (spark, path) not in _STAGED:
        _STAGED.append((spark, path))
    return path


def bucketed(df: DataFrame, name: str, key: str, buckets: int, folder: str | None = None) -> DataFrame:
    """Write df as a table bucketed and sorted by a key, to be joined by merges. It goes with the application, unless a folder
    is given: there its files stay, and reopened() finds them."""
    spark = df.sparkSession
    ship(spark)
    rows = df.repartition(buckets, key).sortWithinPartitions(key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder or app_dir(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    _TABLES.append((spark, name))
    return spark.table(name)


def reopened(spark: SparkSession, name: str, schema: str, key: str, buckets: int, folder: str) -> DataFrame:
    """A table that bucketed() left in a folder, in this or an earlier application."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'")
        _TABLES.append((spark, name))
    return spark.table(name)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system it is."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename within a file system; the folder above is made where it is missing."""
    fs, p = _at(spark, old)
    q = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{old} could not become {new}")


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """The part files of a folder one after the other as one file, streamed from file system to file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, p = _at(spark, folder)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(target), True)
    try:
        for part in sorted(str(f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")):
            source = fs.open(jvm.org.apache.hadoop.fs.Path(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    finally:
        out.close()


def tail(spark: SparkSession, path: str, most: int) -> bytes:
    """The last `most` bytes of a file."""
    fs, p = _at(spark, path)
    size = fs.getFileStatus(p).getLen()
    data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray
    source = fs.open(p)
    try:
        source.seek(max(0, size - most))
        return bytes(data(source))
    finally:
        source.close()


def _clean() -> None:
    for spark, name in _TABLES:
        with suppress(Exception):  # the session may have been stopped
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _STAGED:
        try:
            remove(spark, path)
        except Exception:
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


atexit.register(_clean)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle: the session's setting, at least `least`."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
