"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codexmill")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through the shared folder, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_codexmill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.join("codexmill", os.path.relpath(os.path.join(folder, n), here)))
    path = f"{shared_folder(spark)}/codexmill-{uuid.uuid4().hex}.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path)
    sc._codexmill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error, as executors would not see each other's files."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_folder, "_own", None)
        if found is None:
            found = shared_folder._own = tempfile.mkdtemp(prefix="codexmill-")
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage, survives the loss of an executor, and keeps columns compressed. The
    folder belongs to the session's owner, who clears it with the other checkpoints; `discard`
    removes a table that is no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the schema is known, so the reader need not open a footer, and an empty table keeps its columns
    out = spark.read.schema(df.schema).parquet(path)
    out._codexmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table written by `materialise`; anything else is left alone."""
    path = getattr(df, "_codexmill_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
