"""Small files of metadata on any file system that Spark can reach."""

from __future__ import annotations

import os
import shutil
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from ..errors import ConcurrentCommitError


def local_path(path: str) -> str | None:
    """The path on this machine, or None for a remote file system."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path if url.scheme else path
    return None


class FileStore:
    """List, read, create and probe files. Local files go through the OS, others through Hadoop."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, path: str) -> bool:
        if (p := local_path(path)) is not None:
            return os.path.exists(p)
        fs, p = self._fs(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """File names in a folder, none if it is missing."""
        if (p := local_path(path)) is not None:
            return sorted(os.listdir(p)) if os.path.isdir(p) else []
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        if (p := local_path(path)) is not None:
            return os.path.getsize(p)
        fs, p = self._fs(path)
        return fs.getFileStatus(p).getLen()

    def read_text(self, path: str) -> str:
        if (p := local_path(path)) is not None:
            with open(p, encoding="utf-8") as f:
                return f.read()
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Create a file that must not exist yet; its content appears at once."""
        if (p := local_path(path)) is not None:
            os.makedirs(os.path.dirname(p), exist_ok=True)
            temp = f"{os.path.dirname(p)}/.{os.path.basename(p)}.{os.getpid()}.{os.urandom(4).hex()}"
            with open(temp, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(temp, p)  # fails if another writer was first
            except FileExistsError as e:
                raise ConcurrentCommitError(f"{path} has been written by another commit") from e
            finally:
                os.unlink(temp)
            return
        fs, p = self._fs(path)
        temp = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{os.urandom(6).hex()}.tmp")
        fs.mkdirs(p.getParent())
        out = fs.create(temp, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if fs.exists(p) or not fs.rename(temp, p):
            fs.delete(temp, False)
            raise ConcurrentCommitError(f"{path} has been written by another commit")

    def delete(self, path: str) -> None:
        if (p := local_path(path)) is not None:
            if os.path.exists(p):
                os.unlink(p)
            return
        fs, p = self._fs(path)
        fs.delete(p, False)

    def delete_folder(self, path: str) -> None:
        """Delete a folder and all below it, if it is there."""
        if (p := local_path(path)) is not None:
            shutil.rmtree(p, ignore_errors=True)
            return
        fs, p = self._fs(path)
        fs.delete(p, True)
