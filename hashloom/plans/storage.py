"""Where long plans are cut: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def reliable(df: DataFrame) -> DataFrame:
    """The frame, checkpointed: its lineage ends in files that survive a lost executor. The folder is the session's
    spark.checkpoint.dir; where that is unset it is one of our own in local mode and an error elsewhere."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="hashloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def _file(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark, path: str) -> bool:
    _, p, fs = _file(spark, path)
    return fs.exists(p)


def switch(spark, path: str, text: str) -> None:
    """Replace a small file at once: it is written beside and renamed over the old one."""
    jvm, new, fs = _file(spark, f"{path}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, old, _ = _file(spark, path)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(old), options)


def current(spark, path: str) -> str:
    """What `switch` wrote last."""
    return "\n".join(r["value"] for r in spark.read.text(path).collect())
