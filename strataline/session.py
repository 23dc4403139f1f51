"""Sessions: settings for this engine, and its code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow."""
    builder = SparkSession.builder.master(master).appName("strataline")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for driver and executors; without one, a folder of our own, where they are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"checkpoints-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows, their lineage cut at a checkpoint in the shared folder, which outlives executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """A folder of its own in the shared folder for the tables of a loop; `keep` writes what stays, `drop` removes the rest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark).rstrip('/')}/loop-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        """The same rows as a written table: without lineage, with known size."""
        self.n += 1
        return self._written(df, f"{self.folder}/{self.n}")

    def keep(self, df: DataFrame) -> DataFrame:
        return self._written(df, f"{self.folder}-result")

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that they need no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_strataline_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="strataline-")
    path = os.path.join(folder, "strataline-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(f.relative_to(PACKAGE.parent)))
    sc.addPyFile(path)
    sc._strataline_shipped = True
    return spark
