"""Session settings and the shared scratch folder.

Lineage is cut with tables written under ``spark.checkpoint.dir``, the folder
that every executor of a cluster can reach, so that a lost executor costs a
re-read and nothing else.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_shipped: set[str] = set()
_temporary: list[str] = []


def local_session(app: str = "strandloom", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests, the bench and the command line."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once an application.

    Spark hands the archive to every executor, so the package need not be
    installed on them.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    # Executors that start later fetch the archive too, so it stays until exit.
    archive = Path(_temporary_folder()) / "strandloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def _temporary_folder() -> str:
    _temporary.append(tempfile.mkdtemp(prefix="strandloom-"))
    return _temporary[-1]


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode a temporary folder stands in when it is unset.

    Raises on a cluster without the setting: a folder of one machine would be
    unreadable for the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = _temporary_folder()
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def settle(df: DataFrame, tag: str = "step", parts: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here.

    A written table also tells the optimiser its size, which a checkpointed RDD
    does not. ``parts`` names a column whose values become folders of their
    own, so that reading one value reads nothing else. Folders are removed by
    :func:`drop_settled` or at exit.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(parts) if parts else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared scratch folder, removed at exit."""
    path = f"{scratch_root(spark)}/strandloom-{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def drop_settled(*frames: DataFrame | None) -> None:
    """Delete the folders of settled frames that no later step reads."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path:
            _delete(df.sparkSession, path)
            _written.pop(path, None)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
    for folder in _temporary:
        shutil.rmtree(folder, ignore_errors=True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, the base of every derived split count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
