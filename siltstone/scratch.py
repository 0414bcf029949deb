"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siltstone.errors import StorageError


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a master on this machine (as in tests) gets a temporary one; on a
    cluster that is an error, as a local folder would not be shared.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_roots: set[str] = set()

#: Without its native library Hadoop's local file system starts a process (chmod) for each file, also for ``.crc`` files
#: and success marks. Until that has loaded its program, the system shows it as another JVM with all of its memory.
#: Parquet's page checksums are verified on reading instead. File systems that are not local don't see this.
_FEWER_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_VERIFY = "parquet.page.verify-checksum.enabled"


class Scratch:
    """Written tables that cut lineage. ``drop`` removes those that nothing reads any more.

    Results read some of them lazily; ``clear_scratch`` removes what is left once results are stored.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        _roots.add(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back; the table's place is in ``.scratch_path``."""
        path = self.path(name)
        df.write.options(compression="zstd", **_FEWER_FILES).parquet(path)
        out = self.spark.read.option(_VERIFY, "true").schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *saved: DataFrame | str) -> None:
        for one in saved:
            remove(self.spark, one if isinstance(one, str) else one.scratch_path)

    def clear(self) -> None:
        """Remove everything that was written here."""
        _roots.discard(self.root)
        remove(self.spark, self.root)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are begun inside go at the end: for results that are stored inside."""
    before = set(_roots)
    try:
        yield
    finally:
        for root in _roots - before:
            _roots.discard(root)
            remove(spark, root)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this process; results that were not stored can no longer be read."""
    while _roots:
        remove(spark, _roots.pop())
