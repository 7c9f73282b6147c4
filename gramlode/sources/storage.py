"""Small files and folders on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside, then renamed, so that readers see the old text or the new one."""
    fs, p = _place(spark, path)
    _, new = _place(spark, path + ".new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(new, p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _place(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.delete(p, True)


def total_size(spark: SparkSession, path: str) -> int:
    fs, p = _place(spark, path)
    return fs.getContentSummary(p).getLength()


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)]


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. A local session may do without it and gets one below its warehouse."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.work"
    return f"{base}/{uuid.uuid4().hex}"
