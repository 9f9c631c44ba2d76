"""Session helpers: shared scratch space and cuts in long lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL_DIRS: dict[str, str] = {}
_CUTS: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="twinfold-")
        atexit.register(_remove, _LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Ends the lineage there, so that later jobs neither recompute it nor depend on
    the executors that made it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/twinfold-{uuid.uuid4().hex}"
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that this application's ``cut`` wrote, once their results are no longer read; gives their number."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def drop_cut(df: DataFrame) -> None:
    """Delete the one table that ``cut`` gave as ``df``, once nothing reads it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="twinfold-zip-")
    atexit.register(_remove, folder)
    path = f"{folder}/twinfold.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
