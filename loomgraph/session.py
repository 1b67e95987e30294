"""Sessions, checked joins and tables written to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes (see `row_bytes`) up to which the right side of `bounded_join` is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Temporary folders made here, by application.
_MADE: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as it is held for a broadcast: 16 for each column, and its texts."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum(texts, F.lit(16 * len(df.columns))).cast("long")


def bounded_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_bytes: int | None = None) -> DataFrame:
    """Join that broadcasts `right` only after measuring that it has at most `max_bytes`
    (BROADCAST_BYTES by default); a larger `right` is joined by shuffle, where AQE splits skewed
    keys. `right` is computed once, into the shared folder. Its columns are plain values."""
    right = written(right, "side")
    size = right.agg(F.coalesce(F.sum(row_bytes(right)), F.lit(0)).alias("n")).first()["n"]
    small = size <= (BROADCAST_BYTES if max_bytes is None else max_bytes)
    return left.join(F.broadcast(right) if small else right, on, how)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset and
    the master is local, a temporary folder which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = _MADE[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="loomgraph-")
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomgraph/{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Deletes the tables this application has written to the shared folder, and a temporary
    folder made for them; results that read them must have been stored elsewhere. Call it at the
    end of a job."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/loomgraph")
    at = at if spark.sparkContext.applicationId in _MADE else spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    made = _MADE.get(spark.sparkContext.applicationId)
    if made and os.path.isdir(made) and not os.listdir(made):
        os.rmdir(made)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """`df` as a parquet table in the shared folder: lineage ends here, the rows are
    computed once and outlive any executor. `codec`: another compression than the session's."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=codec)
    return spark.read.schema(schema).parquet(path)


def text_written(lines: DataFrame, name: str) -> str:
    """The path of a text table of the lines (one string column) in the shared folder."""
    path = f"{_own_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
