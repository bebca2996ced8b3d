"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "sylvan", **conf: str) -> SparkSession:
    """A local session as tests and bench use it; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` (or an earlier ``setCheckpointDir``) names. Only a local session, as
    in tests, may leave both out: driver and tasks are then one process, and a temporary folder is taken
    and made known to Spark. On a cluster that is an error, since executors would write to different disks.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc.getCheckpointDir()
    if known is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="sylvan-shared-")
        sc.setCheckpointDir(named)
    return (named or known).rstrip("/")


_written: dict[str, SparkSession] = {}


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that lives as long as the driver, if it isn't freed."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def via_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, computed once: a written table, not a checkpoint, which would compute the rows twice."""
    return via_table(df, "cut")


def _delete(path: str) -> None:
    spark = _written.pop(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free(*tables: DataFrame) -> None:
    """Delete written tables. Only for those of which every reader's rows have been written in their turn."""
    for t in tables:
        if t._table_path in _written:
            _delete(t._table_path)


@atexit.register
def _remove() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended; whoever owns the folder clears it
            return
