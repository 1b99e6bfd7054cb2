"""Helpers that the operators share: tables, the shared folder, defined handling of odd input."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; where it is unset, one of our own in local mode and an error elsewhere."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="hashloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage ends there, and a lost executor loses nothing.
    The caller's session owns the folder; `drop_stored` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OWN = re.compile(r"/[a-z][a-z0-9-]*-[0-9a-f]{32}$")


def drop_stored(df: DataFrame) -> None:
    """Delete the folders that `stored` made for tables `df` reads; inputs and whatever others wrote stay, wherever they lie. Call it once
    `df` and what was derived from it are written or no longer needed."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    root = root.getFileSystem(conf).makeQualified(root)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(conf)
        p = fs.makeQualified(p)
        if _OWN.search(folder) and p.getParent().equals(root):
            fs.delete(p, True)


_published: set[tuple[str, str]] = set()


def published(spark: SparkSession, data: bytes, label: str) -> str:
    """Write bytes as a file in the shared folder, from where each executor fetches a copy once; the file's name there (see `local_file`)."""
    name = f"{label}-{hashlib.sha256(data).hexdigest()[:24]}"
    key = spark.sparkContext.applicationId, name
    if key not in _published:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/published-{uuid.uuid4().hex}/{name}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(p, True)
        try:
            for at in range(0, len(data), 1 << 24):
                out.write(bytearray(data[at : at + (1 << 24)]))
        finally:
            out.close()
        spark.sparkContext.addFile(fs.makeQualified(p).toString())
        _published.add(key)
    return name


def local_file(name: str) -> str:
    """Path of a published file within a task."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names, null texts as empty ones. Other columns, whatever their names, are left out here."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
