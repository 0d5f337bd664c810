"""Versioned storage of indexes: segments that never change, and numbered manifests that name them.

A version is published by one small file, written last: readers see the version before it or the whole new one, and a
build that fails leaves what was there. An append adds a segment; ``compact`` writes the segments as one; ``clean`` deletes
segments that no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .scratch import WIDE


class Versioned:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        """The published versions, oldest first."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def there(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        """version, about, segments, tables of a version, the newest by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path}: no version{'' if version is None else f' {version}'}")
        file = self._at("manifests", f"{known[-1] if version is None else version:08d}.json")
        return json.loads(self.spark.read.text(file.toString(), wholetext=True).first().value)

    def about(self) -> dict:
        return self.manifest()["about"]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        segments = self.manifest(version)["segments"]
        return self._tables([s for s in segments if self._holds(s, name)], name)

    def _holds(self, segment: str, name: str) -> bool:
        """A table partitioned by a column has no file, and no schema, where it has no row."""
        folder = self._at("segments", segment, name)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return any(not n.startswith("_") or "=" in n for n in names)

    def _tables(self, segments: list[str], name: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s}/{name}") for s in segments]
        if not parts:
            raise FileNotFoundError(f"{self.path}: no table {name}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _write(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]]) -> str:
        segment = uuid.uuid4().hex
        for name, df in tables.items():
            writer = df.write.options(**WIDE)
            writer = writer.partitionBy(*partition_by[name]) if name in partition_by else writer
            writer.parquet(f"{self.path}/segments/{segment}/{name}")
        return segment

    def publish(self, tables: dict[str, DataFrame], about: dict, append: bool = False, partition_by: dict[str, list[str]] | None = None, check: Callable[[DataFrame], None] | None = None) -> int:
        """A new version of these tables alone, or with ``append`` of the newest version and these. What ``about`` says has to
        be the same in an append. check: is given the first table as written, and may refuse it by an error."""
        known = self.versions()
        old = self.manifest() if append and known else None
        if old and old["about"] != about:
            raise ValueError(f"{self.path} was made with {old['about']}, and not {about}")
        segment = self._write(tables, partition_by or {})
        if check:
            check(self._tables([segment], next(iter(tables))))
        return self._commit(known, about, [*(old["segments"] if old else []), segment], partition_by or {})

    def _commit(self, known: list[int], about: dict, segments: list[str], partition_by: dict) -> int:
        version = (known[-1] if known else 0) + 1
        draft, final = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "about": about, "segments": segments, "partition_by": partition_by}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: version {version} was published by another writer")
        return version

    def compact(self) -> int:
        """The newest version, with one segment in place of all."""
        old = self.manifest()
        names = sorted({f.getPath().getName() for s in old["segments"] for f in self._fs.listStatus(self._at("segments", s))})
        segment = self._write({n: self.read(n) for n in names}, old["partition_by"])
        return self._commit(self.versions(), old["about"], [segment], old["partition_by"])

    def clean(self, keep: int = 1) -> int:
        """Delete manifests but the newest ``keep``, and what no kept one names: older segments, and those of failed builds. Not
        while another build is under way. How many segments went."""
        known = self.versions()
        kept = {s for v in known[-keep:] for s in self.manifest(v)["segments"]}
        gone = 0
        for v in known[:-keep]:
            self._fs.delete(self._at("manifests", f"{v:08d}.json"), False)
        if self._fs.exists(self._at("segments")):
            for f in self._fs.listStatus(self._at("segments")):
                if f.getPath().getName() not in kept:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone

    def delete(self) -> None:
        self._fs.delete(self._root, True)
