"""Session helpers: table access, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_SHIPPED: set[str] = set()
#: Removes the shuffle files of an action at its end.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each application.

    Python workers import it by name; where it is not installed on their hosts
    the zipped sources, distributed by Spark, take its place.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-py-"), "tidemark-src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table (a file or a folder) of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (local tests) a temporary folder is made
    and set; on a cluster the setting must exist.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below a folder of this application."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has cut into the shared folder; frames read from there are gone then, so call it once their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    The written table replaces the lineage, so a lost executor costs a re-read
    and never a recomputation of what came before. With ``sweep`` the shuffle
    files of the write go when it is done, else when the driver collects garbage.
    """
    path = scratch(df.sparkSession, name)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(SWEEP, None)
    if sweep:
        conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if sweep:
            conf.set(SWEEP, before) if before is not None else conf.unset(SWEEP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def uncut(df: DataFrame) -> None:
    """Remove what ``cut`` has written for ``df``; neither it nor a frame made from it may be read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(url: str) -> str:
    """The file system path of a ``file:`` URL; other text unchanged."""
    return url[len("file://"):] if url.startswith("file://") else url


def tokenizer_dir() -> str:
    """Folder of the public tokenizer files (``TIDEMARK_TOKENIZERS`` overrides it)."""
    return os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """An empty frame of ``schema``."""
    return spark.createDataFrame([], schema)
