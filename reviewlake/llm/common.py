"""What the corpus operators share: reading tables, staging results in the shared folder, hashing constants."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import delete, shared_dir

#: A word is a maximal run of anything but ASCII white space (as a pattern for Java and for Python).
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder; read by Spark alone, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends, if not before by ``drop``."""
    path = f"{shared_dir(spark)}/reviewlake/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A staged table, to be broadcast if it has at most ``most`` rows, which are narrow, and else joined by hash."""
    return F.broadcast(ids) if ids.count() <= most else ids


def drop(*frames: DataFrame) -> None:
    """Removes what ``staged`` has written for these, once nothing will read them again."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            delete(df.sparkSession, path)
            _staged[:] = [x for x in _staged if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; nothing more can be done at exit
            return


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Python workers get at most so many rows, and about so many bytes, at a time: it bounds their memory where texts
    are long. It changes no result. The two settings stay in the session, since Spark reads them when a query runs and
    not when it is made; smaller ones are left as they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > size:
        spark.conf.set(name, str(size))


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """Only ``doc_id``, ``text`` and the named columns, so that further columns can clash with nothing."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *extra)


def held_out(doc_id):
    """True for the third of the rows on which learned models are judged and never trained."""
    return F.crc32(doc_id.cast("string")) % 3 == 1
