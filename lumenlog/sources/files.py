"""Small files beside a table: records that appear whole or not at all, on whatever file system Spark writes to."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Hadoop's file API for a few names on the driver; rows never pass through it."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none where it does not exist."""
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.delete(p, True)

    def delete_uri(self, uri: str) -> bool:
        """Delete a file named as in ``_metadata.file_path``, where special characters are escaped."""
        p = self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(uri))
        return p.getFileSystem(self._conf).delete(p, False)

    def claim(self, path: str, text: str) -> bool:
        """Write a new file whole; False where there is one already. Two that claim one name can't both succeed.

        The text is written beside it and renamed, so no reader sees half of it. (A store without atomic renames needs
        its own committer for that.)
        """
        p, fs = self._at(path)
        fs.mkdirs(p.getParent())
        draft = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_draft-{self._jvm.java.util.UUID.randomUUID()}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf)
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self._jvm.java.lang.reflect.Array.newInstance(rename, 0)  # no option: an existing file is never replaced
        try:
            context.rename(draft, p, none)
            return True
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
