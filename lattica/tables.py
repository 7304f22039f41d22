"""Reading the given Parquet tables, and tables of one's own in between."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
#: What this process has stored and not yet removed.
_stored: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; a file or a folder of part files, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where that is unset and the master is local, as in tests, a temporary
    folder is made and set; it goes when the process ends. On a cluster that
    would be a folder of each machine's own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation of
    what lies before, and each reader prunes columns on its own. ``tidy``
    removes such tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> int:
    """Remove all tables that ``stored`` has made in this process, and say how many.

    Results that still read them must have been written or collected before.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    n = len(_stored)
    while _stored:
        old = path(_stored.pop())
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return n
