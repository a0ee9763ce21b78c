"""Small files and folders through Spark's own file system layer, so that any store Spark reads can hold them."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if there is one."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def publish(self, name: str, text: str) -> bool:
        """Make a file appear under a new name; false if the name is taken.

        The name is taken first, by an exclusive create of a mark beside it, so of two writers one alone goes on to rename.
        """
        parts = name.rsplit("/", 1)
        mark, held = ("/".join([*parts[:-1], f".{parts[-1]}.{x}"]) for x in ("taken", self.jvm.java.util.UUID.randomUUID().toString()))
        if self.exists(name) or not self.create(mark, ""):
            return False
        self.create(held, text)
        if self.fs.rename(self.path(held), self.path(name)):
            return True
        self.fs.delete(self.path(held), False)
        self.fs.delete(self.path(mark), False)
        return False

    def read(self, name: str) -> str:
        source = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(n for s in self.fs.listStatus(self.path(folder)) if not (n := s.getPath().getName()).startswith("."))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def found(self, pattern: str) -> list[tuple[str, int]]:
        """Names of a pattern of one file in one folder each, and their times of modification in milliseconds."""
        return [("/".join(s.getPath().toString().rsplit("/", 2)[1:]), s.getModificationTime()) for s in self.fs.globStatus(self.path(pattern))]

    def touch(self, name: str, millis: int) -> None:
        """Set the time of modification, where the file system keeps it."""
        self.fs.setTimes(self.path(name), millis, -1)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
