"""A folder on a local or a Hadoop file system, with the one operation that commits need: create a file if it is new.

On Hadoop file systems that is a rename that fails if its target exists, which is one step on those of :data:`ATOMIC`.
Object stores without such a rename are refused for commits rather than trusted.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib

from pyspark.sql import SparkSession


#: Schemes of Hadoop file systems whose rename is one step.
ATOMIC = ("hdfs", "viewfs", "webhdfs", "swebhdfs", "abfs", "abfss", "ofs", "o3fs", "maprfs")


class Folder:
    """Files below ``root``; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.local = "://" not in root or root.startswith("file:")
        self.root = ("/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root).rstrip("/")
        if not self.local:
            jvm = spark._jvm
            self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def uri(self, name: str) -> str:
        """The name as Spark reads it."""
        return f"file://{os.path.abspath(self.root)}/{name}" if self.local else f"{self.root}/{name}"

    def _at(self, name: str) -> str:
        return os.path.join(self.root, name) if name else self.root

    def exists(self, name: str = "") -> bool:
        return os.path.exists(self._at(name)) if self.local else self._fs.exists(self._path(name))

    def list(self, name: str = "") -> list[str]:
        """Names in a folder, none if it is not there."""
        if not self.exists(name):
            return []
        if self.local:
            return sorted(os.listdir(self._at(name)))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> bytes:
        if self.local:
            with open(self._at(name), "rb") as f:
                return f.read()
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a file that must not exist; False if it does. Readers see the whole file or none."""
        beside = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}".lstrip("/")
        self.write(beside, data)
        try:
            if self.local:
                os.link(self._at(beside), self._at(name))
                return True
            return self._rename_new(beside, name)
        except FileExistsError:
            return False
        finally:
            self.delete(beside)

    def _rename_new(self, beside: str, name: str) -> bool:
        scheme = self.root.split("://")[0]
        if scheme not in ATOMIC:
            raise OSError(f"{scheme} cannot create a file in one step, so commits could be lost")
        jvm, java = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        kinds = java.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(self._path(beside), self._path(name), kinds)
            return True
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files in a folder."""
        if not self.local:
            return self._fs.getContentSummary(self._path(name)).getLength()
        at = self._at(name)
        if not os.path.isdir(at):
            return os.path.getsize(at)
        return sum(os.path.getsize(os.path.join(folder, n)) for folder, _, names in os.walk(at) for n in names)

    def walk(self) -> list[str]:
        """Names of all files below, hidden ones of commits in the making left out."""
        if not self.exists():
            return []
        if self.local:
            found = [os.path.relpath(os.path.join(folder, n), self.root) for folder, _, names in os.walk(self.root) for n in names]
        else:
            found, files = [], self._fs.listFiles(self._path(""), True)
            top = self._fs.makeQualified(self._path("")).toUri()
            while files.hasNext():
                found.append(top.relativize(files.next().getPath().toUri()).getPath().lstrip("/"))
        return sorted(n for n in found if n != ".lock")

    def copy(self, name: str, to: Folder, new: str | None = None) -> None:
        """A file or a folder with all in it, copied without passing through Python."""
        new = name if new is None else new
        if self.local and to.local:
            os.makedirs(os.path.dirname(to._at(new)), exist_ok=True)
            at = self._at(name)
            shutil.copytree(at, to._at(new), dirs_exist_ok=True) if os.path.isdir(at) else shutil.copy2(at, to._at(new))
            return
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        here, there = (jvm.org.apache.hadoop.fs.Path(f.uri(n)) for f, n in ((self, name), (to, new)))
        jvm.org.apache.hadoop.fs.FileUtil.copy(here.getFileSystem(conf), here, there.getFileSystem(conf), there, False, True, conf)

    def write(self, name: str, data: bytes) -> None:
        if self.local:
            os.makedirs(os.path.dirname(self._at(name)), exist_ok=True)
            with open(self._at(name), "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            return
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(data))
        stream.close()

    def delete(self, name: str) -> None:
        """Remove a file or a folder with all in it."""
        if not self.local:
            self._fs.delete(self._path(name), True)
        elif os.path.isdir(self._at(name)):
            shutil.rmtree(self._at(name), ignore_errors=True)
        elif os.path.exists(self._at(name)):
            os.remove(self._at(name))

    def crc(self, name: str) -> int:
        """The CRC-32 of a file, read in pieces."""
        crc = 0
        if self.local:
            with open(self._at(name), "rb") as f:
                while part := f.read(1 << 20):
                    crc = zlib.crc32(part, crc)
            return crc
        stream = self._fs.open(self._path(name))
        try:
            while part := bytes(stream.readNBytes(1 << 20)):
                crc = zlib.crc32(part, crc)
            return crc
        finally:
            stream.close()
