"""Stored tables whose changes are versions (K1-K4 on disk): readers see one version whole, failed writes leave no trace.

A table is a folder of rows, dealt into a fixed number of buckets by a key, and a folder of manifests. A manifest is a
version: for each bucket the folder that holds its rows, and marks of what has been taken in so far. A change writes the
buckets it touches to a new folder, then publishes the next manifest by one rename that fails if that version is there
already. Until then nobody sees it; afterwards, readers of older versions still find their rows.

A manifest has a line for each bucket, whatever the number of rows or keys. No lists of keys reach the driver, only bucket
numbers. Rows of one bucket are written by as many tasks as their size asks for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another writer published the version first; the change must be made again on the newer one."""


@dataclass(frozen=True)
class Manifest:
    """One version: the folder of each bucket that has rows, and the last epoch taken in from each stream."""

    version: int = 0
    parts: dict[int, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def to_text(self) -> str:
        return json.dumps({"version": self.version, "parts": self.parts, "marks": self.marks}, sort_keys=True)

    @staticmethod
    def of_text(text: str) -> Manifest:
        read = json.loads(text)
        return Manifest(read["version"], {int(b): p for b, p in read["parts"].items()}, read["marks"])


class Files:
    """The few file operations a version needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.at(path).getFileSystem(self._conf)

    def at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        folder = self.at(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self.at(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._fs.create(self.at(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, source: str, target: str) -> bool:
        """Moves a file to a name that nothing has yet; False if something has."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(target).toUri(), self._conf)
        self._fs.mkdirs(self.at(target).getParent())
        no_options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.at(source), self.at(target), no_options)
        except Py4JJavaError as problem:
            if problem.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                self.remove(source)
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self._fs.delete(self.at(path), True)


class VersionedTable:
    """Rows of one shape below a path; ``key`` deals them into buckets and must be in every row of a change."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.shape = spark.createDataFrame([], schema).schema
        self._files = Files(spark, path)

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._files.names(f"{self.path}/manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, by default the newest one's; a table never written has version 0 and no rows."""
        known = self.versions()
        if version is None:
            version = max(known, default=0)
        elif version and version not in known:
            raise ValueError(f"version {version} of {self.path} is not there; known are {known}")
        return Manifest.of_text(self._files.read(self._manifest_path(version))) if version else Manifest()

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; later changes don't alter what the DataFrame reads."""
        return self._rows(self.manifest(version), None)

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _rows(self, manifest: Manifest, buckets: list[int] | None) -> DataFrame:
        chosen = manifest.parts if buckets is None else {b: p for b, p in manifest.parts.items() if b in set(buckets)}
        if not chosen:
            return self.spark.createDataFrame([], self.shape)
        return self.spark.read.schema(self.shape).parquet(*[f"{self.path}/{p}" for _, p in sorted(chosen.items())])

    def change(
        self, keys: DataFrame, make: Callable[[DataFrame], DataFrame], mark: tuple[str, int] | None = None,
        before_publishing: Callable[[], None] = lambda: None,
    ) -> int:
        """Publishes a version in which ``make(old)`` stands for the old rows of all buckets that ``keys`` touches.

        With ``mark`` (stream, epoch) a change of an epoch already taken in is left out, so a replayed one changes
        nothing. Returns the newest version. Raises VersionConflict if another writer was faster.
        """
        base = self.manifest()
        if mark and base.marks.get(mark[0], -1) >= mark[1]:
            return base.version
        touched = sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # bucket numbers
        folder = f"data/{uuid.uuid4().hex}"
        rows = make(self._rows(base, touched)).select(*self.shape.names, self.bucket().alias(BUCKET))
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = self._files.names(f"{self.path}/{folder}")
        written = {int(n.partition("=")[2]) for n in names if n.startswith(f"{BUCKET}=")}
        if not written <= set(touched):
            self._files.remove(f"{self.path}/{folder}")
            raise ValueError("a change made rows with keys that it didn't name")
        before_publishing()
        parts = {b: p for b, p in base.parts.items() if b not in set(touched)}
        parts |= {b: f"{folder}/{BUCKET}={b}" for b in written}
        marks = base.marks | ({mark[0]: mark[1]} if mark else {})
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self._files.write(draft, Manifest(base.version + 1, parts, marks).to_text())
        if not self._files.publish(draft, self._manifest_path(base.version + 1)):
            raise VersionConflict(f"version {base.version + 1} of {self.path} is there already")
        return base.version + 1

    def upsert(self, new: DataFrame, keys: list[str], mark: tuple[str, int] | None = None) -> int:
        """K1: rows of ``new`` replace rows of the same keys (the bucket's key is one of them), others are added."""
        new = new.select(*self.shape.names)
        return self.change(new, lambda old: new.unionByName(old.join(new.select(*keys), keys, "left_anti")), mark)

    def delete(self, gone: DataFrame, keys: list[str], mark: tuple[str, int] | None = None) -> int:
        """K4: rows of the given keys go."""
        wanted = gone.select(*keys).distinct()
        return self.change(wanted, lambda old: old.join(wanted, keys, "left_anti"), mark)

    def forget(self, keep: int = 2) -> list[int]:
        """Drops all but the newest versions and the rows only they hold; returns the versions left.

        To be run while no change is under way: rows written but not published yet belong to no version.
        """
        known = self.versions()
        left = sorted(known)[-keep:]
        used = {p for v in left for p in self.manifest(v).parts.values()}
        for version in set(known) - set(left):
            self._files.remove(self._manifest_path(version))
        for folder in self._files.names(f"{self.path}/data"):
            parts = [f"data/{folder}/{n}" for n in self._files.names(f"{self.path}/data/{folder}")]
            held = [p for p in parts if p in used]
            for gone in ([p for p in parts if p not in used and f"/{BUCKET}=" in p] if held else [f"data/{folder}"]):
                self._files.remove(f"{self.path}/{gone}")
        return left
