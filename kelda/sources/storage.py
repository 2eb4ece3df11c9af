"""Small files on whatever file system a path names: Hadoop's, so that a table's pointer lies where the table does."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Storage:
    """Files below paths of any scheme that the session's Hadoop knows; a plain path is of its default file system."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._files(path).exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder, sorted; none where there is no folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._files(folder).listStatus(self._path(folder)))

    def read(self, path: str) -> str:
        """FileNotFoundError where there is no such file."""
        if not self.exists(path):
            raise FileNotFoundError(path)
        stream = self._files(path).open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes a file in one step: readers see the old text or the new one."""
        part = f"{path}.{uuid.uuid4().hex}"
        out = self._files(path).create(self._path(part), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, overwrite)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files(path).makeQualified(self._path(path)).toUri(), self._conf)
        context.rename(self._path(part), self._path(path), options)

    def remove(self, path: str) -> None:
        self._files(path).delete(self._path(path), True)
