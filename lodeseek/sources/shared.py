"""Places that driver and executors share, and small files there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on one machine may leave it unset: it gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodeseek-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Folder:
    """A folder in any file system that Spark reaches: names, and small texts read and written whole."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        if not self._fs.exists(self.at(sub)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(sub)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, name: str) -> bool:
        """Make an empty file that isn't there yet; False if it is."""
        try:
            self._fs.create(self.at(name), False).close()
        except Exception as error:
            if self._fs.exists(self.at(name)):
                return False
            raise error
        return True

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        half = self.at(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(half, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(half, self.at(name)):
            raise OSError(f"{self.path}/{name} can't be written")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self.at(name), True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and sizes are known."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        Folder(df.sparkSession, file.rpartition("/")[0]).delete()
