"""Files of a table through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make_dirs(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def list(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace_text(self, name: str, text: str) -> None:
        """Write beside and rename over: readers see the old file or the new one."""
        stream = self._fs.create(self._path(f"{name}.tmp"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.rename(f"{name}.tmp", name)

    def rename(self, old: str, new: str) -> None:
        fs = self._jvm.org.apache.hadoop.fs
        how = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        overwrite = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[1]
        self._jvm.java.lang.reflect.Array.set(how, 0, overwrite)
        fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root or self.root.startswith("file:") else self._fs.getUri(), self._conf).rename(self._path(old), self._path(new), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
