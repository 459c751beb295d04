"""Several tables loaded as one transaction: a version names the folders of all tables and appears by one rename."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .tables import checked_name

#: Seconds for which folders that no version names are left alone, since a load may still be writing them.
PATIENCE = 7 * 24 * 3600


class _Folder:
    """The folder's files, by the file system that its address names."""

    def __init__(self, spark: SparkSession, path: str):
        hadoop = spark._jvm.org.apache.hadoop
        self.path, self.root, self.fs_package = hadoop.fs.Path, path.rstrip("/"), hadoop.fs
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        self.no_options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 0)

    def at(self, name: str):
        return self.path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[tuple[str, float]]:
        """(name, time of change in seconds) of what a folder holds; nothing where there is none."""
        if not self.fs.exists(self.at(name)):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.at(name))]

    def appear(self, name: str, text: str) -> bool:
        """Make a file of this text appear at once; False where its name is taken."""
        staged = self.at(f"staged/{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.at(name)
        self.fs.mkdirs(target.getParent())
        try:
            self.context.rename(staged, target, self.no_options)
        except Py4JJavaError as e:
            self.fs.delete(staged, False)
            if self.fs.exists(target) and "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions that there are, in order."""
    return sorted(int(n.removesuffix(".json")) for n, _ in _Folder(spark, path).names("versions") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict[str, str]:
    """table -> its folder in one version, the newest if none is named; a version that does not exist raises ValueError.

    No version yet, and none named, is an empty one.
    """
    known = numbers(spark, path)
    if number is None and not known:
        return {}
    if number is not None and number not in known:
        raise ValueError(f"no version {number} in {path}")
    return json.loads(spark.read.text(f"{path.rstrip('/')}/versions/{known[-1] if number is None else number:012d}.json", wholetext=True).first()[0])


def load_together(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Write all tables and make them visible as one new version, whose number is returned; other tables stay as they are.

    Each table goes to a folder of its own, which no reader sees; the version appears by one rename after the last of them.
    If anything fails before, the version before stays the newest and the folders written are left to `sweep`. Two loads
    at once get two versions, the later one built on the earlier; of a table that both load, the later one's stays.
    Needs a file system whose rename fails where the target exists. Names are checked before anything is written. Tables may
    be read from the version that they replace.
    """
    staged = {checked_name(name): f"data/{name}-{uuid.uuid4().hex}" for name in tables}
    folder = _Folder(spark, path)
    for name, df in tables.items():
        df.write.parquet(f"{folder.root}/{staged[name]}")
    while True:
        number = (numbers(spark, path) or [0])[-1] + 1
        if folder.appear(f"versions/{number:012d}.json", json.dumps({**manifest(spark, path, number - 1 or None), **staged}, sort_keys=True)):
            return number


def read_together(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, the newest if none is named; what is loaded afterwards does not change them."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{place}") for name, place in manifest(spark, path, number).items()}


def sweep(spark: SparkSession, path: str, patience: float = PATIENCE) -> list[str]:
    """Delete what failed loads left: folders and files that no version names, unless changed within `patience` seconds."""
    folder, named = _Folder(spark, path), set()
    for number in numbers(spark, path):
        named |= set(manifest(spark, path, number).values())
    old = [f"{part}/{n}" for part in ("data", "staged") for n, changed in folder.names(part) if f"{part}/{n}" not in named and changed <= time.time() - patience]
    for name in old:
        folder.fs.delete(folder.at(name), True)
    return sorted(old)
