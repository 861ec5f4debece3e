"""Named stores and the administrative operations on them."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sources import rdf
from .store import Store, StoreError


class Catalog:
    """Stores by name under a folder: build, load, unload, drop, show, transactions, backup, export, monitor."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.stores: dict[str, Store] = {}
        self.log: list[dict] = []
        self.started = time.time()

    def _path(self, name: str) -> str:
        if not name.replace("_", "").replace("-", "").isalnum():
            raise StoreError(f"odd store name {name!r}")
        return f"{self.root}/{name}"

    def get(self, name: str) -> Store:
        if name not in self.stores:
            raise StoreError(f"store {name!r} is not loaded")
        return self.stores[name]

    def build(self, name: str, paths: list[str]) -> Store:
        self.stores[name] = Store.from_files(self.spark, paths) if paths else Store(self.spark)
        self.checkpoint(name)
        return self.stores[name]

    def load(self, name: str) -> Store:
        if name not in self.stores:
            self.stores[name] = Store.load(self.spark, self._path(name))
        return self.stores[name]

    def unload(self, name: str) -> bool:
        return self.stores.pop(name, None) is not None

    def checkpoint(self, name: str) -> None:
        """Writes the head version as the saved state."""
        self.get(name).save(self._path(name))

    def drop(self, name: str) -> None:
        self.unload(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def show(self) -> list[str]:
        """Saved and loaded stores."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        saved = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
        return sorted(saved | set(self.stores))

    def query(self, name: str, text: str, decode: str = "ntriples"):
        began = time.time()
        out = self.get(name).query(text, decode)
        self.log.append({"store": name, "text": text, "kind": out.kind, "ms": int(1000 * (time.time() - began))})
        return out

    def backup(self, name: str, path: str) -> None:
        self.get(name).backup(path)

    def restore(self, name: str, path: str) -> Store:
        self.stores[name] = Store.restore(self.spark, path)
        return self.stores[name]

    def export(self, name: str, path: str) -> None:
        quads = self.get(name).quads
        rdf.write_ntriples(quads.select("s", "p", "o", "g"), path)

    def batch(self, name: str, path: str, remove: bool = False) -> int:
        """Adds or removes the statements of a file; graph labels of quad files are left out."""
        rows = rdf.read(self.spark, path).withColumn("g", F.lit(None).cast("string"))
        return self.get(name).batch_remove(rows) if remove else self.get(name).batch_insert(rows)

    def monitor(self, name: str) -> dict:
        return self.get(name).stats().first().asDict() | {"version": self.get(name).version(), "up_seconds": int(time.time() - self.started)}
