"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "16g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sightline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Where the setting is absent, as in tests, a temporary folder is made, but
    only for a local master: on a cluster no other machine would see it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jvm = context._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def get_json(spark: SparkSession, path: str):
    """The value of a small JSON file on any file system of the session, or None where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put_json(spark: SparkSession, path: str, value) -> None:
    """Write aside, then rename over: readers see the old value or the new one, never none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_package = jvm.org.apache.hadoop.fs
    final = fs_package.Path(path)
    aside = fs_package.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}")
    fs = final.getFileSystem(conf)
    fs.mkdirs(final.getParent())
    stream = fs.create(aside, True)
    stream.write(json.dumps(value).encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(fs_package.Options.Rename, 1)
    options[0] = fs_package.Options.Rename.OVERWRITE
    context = fs_package.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(aside), fs.makeQualified(final), options)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables written below the shared folder.

    Reading a written table cuts the lineage, so a lost executor costs no more
    than the stages since the last write.  ``drop`` removes tables that no
    later step reads, which keeps the disk in proportion to the input.  What a
    result still reads stays until ``clear``, at the latest until the program ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._leave)

    def _leave(self) -> None:
        try:
            if not self.spark.sparkContext._jsc.sc().isStopped():
                self.clear()
        except Exception:  # noqa: S110 - the session may be gone already
            pass

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def clear(self) -> None:
        """Remove all tables of this scratch space, once the results that read them are stored."""
        delete_path(self.spark, self.root)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                delete_path(self.spark, path)
