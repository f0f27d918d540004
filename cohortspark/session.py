"""Session settings the library expects, and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_WRITTEN: dict[str, list[str]] = {}


def get_session(app_name: str = "cohortspark", **settings: str) -> SparkSession:
    """A session with the library's settings; ``settings`` override them (use "__" for dots)."""
    builder = SparkSession.builder.appName(app_name)
    wanted = SETTINGS | {key.replace("__", "."): value for key, value in settings.items()}
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is not set a local master, whose executors share one machine, takes a folder in the warehouse. On a
    cluster the warehouse may be a folder of each machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes what ``materialize`` and ``new_path`` wrote in this application so far.

    Frames that read it cannot be used any more, so call it when their results are stored.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one result feeds several branches. A written table survives lost executors,
    keeps column pruning for each reader, and tells the planner its real size, so a
    broadcast is only picked when the table is known to be small.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
