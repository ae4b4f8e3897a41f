"""Folders that all executors share, and whole small files in them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder for a table of ours: under the one that the cluster names in spark.checkpoint.dir, a temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or os.path.join(tempfile.gettempdir(), 'barloom')}/{what}-{uuid.uuid4().hex}"


class Files:
    """Small whole files of a folder, wherever Spark keeps it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.system = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def names(self) -> list[str]:
        if not self.system.exists(self.folder):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.folder))

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file, whole or not at all; False if there is one of that name, whoever made it and when."""
        draft = self.path(f".{uuid.uuid4().hex}.draft")
        stream = self.system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self.path(name)
        try:
            if self.system.getScheme() == "file":
                # a local rename replaces its target, a link doesn't
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.jvm.java.nio.file.Files.createLink(local(target), local(draft))
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
                return True
            return not self.system.exists(target) and bool(self.system.rename(draft, target))
        finally:
            self.system.delete(draft, False)

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def age_seconds(self, name: str) -> float:
        """Seconds since the youngest file under ``name`` was written, by this machine's clock."""
        status = self.system.getFileStatus(self.path(name))
        newest = max([status.getModificationTime(), *([s.getModificationTime() for s in self.system.listStatus(self.path(name))] if status.isDirectory() else [])])
        return self.jvm.java.lang.System.currentTimeMillis() / 1000 - newest / 1000
