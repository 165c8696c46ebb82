"""Session-level helpers shared by every operator: tables, code shipping, lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python operators import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="lexspan-"), "lexspan.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to spark.sql.shuffle.partitions parts, for steps that sort or collect by these keys. A number that
    is given holds: left to itself, Spark puts parts together until each is 64 MB of compressed rows, of which sorts take GBs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may go without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "lexspan-checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours by the file system that its path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = (spark, f"{shared_dir(spark)}/lexspan-{uuid.uuid4().hex}")
        if len(_FOLDERS) == 1:
            atexit.register(_clean)
    return _FOLDERS[app][1]


def _clean() -> None:
    for spark, path in _FOLDERS.values():
        try:
            remove(spark, path)
        except Exception:  # the session has ended before the driver's process did
            if "://" not in path:
                import shutil

                shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Tables that one run of an operator writes to the shared folder and rereads: lineage ends there.

    Written tables survive the loss of executors. A name that is put again gets a new folder and its old one goes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{own_folder(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))

    def last(self, df: DataFrame) -> DataFrame:
        """Write the result and delete all that led to it."""
        path = f"{self.folder}/result"
        df.write.parquet(path)
        self.drop(*list(self.paths))
        return self.spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by one written table; it is deleted when the driver ends."""
    return Scratch(df.sparkSession).put(df, "table")
