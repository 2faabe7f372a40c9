"""Cutting lineage between stages: what is written to the shared folder is not computed twice and survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a folder is made for local masters only, since a machine-local one is lost with its machine.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if sc.applicationId not in _own:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='reviewlake-')}"
    return _own[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again. It is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reviewlake/cut-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the reviews: joined by sort and merge, never gathered by the driver to be
    broadcast. Spark's estimates see neither the rows that explode adds nor how far repeated values are compressed."""
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in [*_written, *((s, d) for s, _ in _written[:1] for d in _own.values())]:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; nothing more can be done at exit
            return
