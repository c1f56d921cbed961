"""An index on disk: tables made of immutable parquet parts, and a numbered manifest that names the parts in use.

A batch writes its parts first and then publishes the next manifest by one rename to a name that wasn't there, so
readers see the old index or the new one whatever happens in between. Rows that are added are parts of their own; a
table is rewritten only where rows leave it. ``vacuum`` deletes what no manifest in use names, and with it whatever was
removed from the index.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import FILES, LENGTHS, OLDEST_UPGRADED, PASSAGES, POSTINGS, PROBLEMS, SCHEMA_VERSION, VECTORS

TABLES: dict[str, T.StructType] = {"files": FILES, "passages": PASSAGES, "vectors": VECTORS, "problems": PROBLEMS, "postings": POSTINGS, "lengths": LENGTHS}
#: Parts of a table beyond which it is written anew as one.
MAX_PARTS = 64
_NAME = re.compile(r"manifest-(\d{8})\.json$")


class NewerIndex(Exception):
    """The index was written by a later version and is left untouched."""


class DamagedIndex(Exception):
    """No manifest can be read."""


class Store:
    """``outcome``: fresh, fine, cleared (too old), or upgraded."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.number, found = self._read()
        version = found["schema_version"] if found else None
        if version is not None and version > SCHEMA_VERSION:
            raise NewerIndex(f"version {version}, this is {SCHEMA_VERSION}")
        self.outcome = "fresh" if found is None else "cleared" if version < OLDEST_UPGRADED else "upgraded" if version < SCHEMA_VERSION else "fine"
        if found is None or version < OLDEST_UPGRADED:
            found = {"tables": {}, "meta": {}}
        self.manifest = {"schema_version": SCHEMA_VERSION, "tables": found.get("tables", {}), "meta": found["meta"]}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self) -> list[str]:
        fs, path = self._fs(self.root)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self) -> tuple[int, dict | None]:
        numbers = sorted((int(m[1]) for n in self._list() if (m := _NAME.match(n))), reverse=True)
        for number in numbers:
            rows = self.spark.read.option("wholetext", True).text(f"{self.root}/manifest-{number:08d}.json").collect()
            try:
                found = json.loads(rows[0][0])
                found["schema_version"], found["meta"]
                return number, found
            except (ValueError, KeyError, TypeError, IndexError):
                continue  # not whole: the one before it holds
        if numbers:
            raise DamagedIndex(self.root)
        return 0, None

    def _publish(self) -> None:
        self.number += 1
        fs, path = self._fs(f"{self.root}/manifest-{self.number:08d}.json")
        _, new = self._fs(f"{self.root}/.new-{uuid.uuid4().hex}")
        fs.mkdirs(path.getParent())
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.manifest), "utf-8"))
        out.close()
        if not fs.rename(new, path):
            fs.delete(new, False)
            raise FileExistsError(f"another writer made {path}")

    def table(self, name: str) -> DataFrame:
        parts = [f"{self.root}/{p}" for p in self.manifest["tables"].get(name, ())]
        return self.spark.read.schema(TABLES[name]).parquet(*parts) if parts else self.spark.createDataFrame([], TABLES[name])

    def commit(self, add: dict[str, DataFrame] | None = None, meta: dict[str, str] | None = None, **tables: DataFrame) -> None:
        """One step: ``tables`` replace what the index holds under their names, the rows of ``add`` come to the rest."""
        parts = {name: list(p) for name, p in self.manifest["tables"].items()}
        for name, rows in [*tables.items(), *(add or {}).items()]:
            where = f"{name}/part-{uuid.uuid4().hex}"
            extra = name not in tables
            if extra and len(parts.get(name, ())) >= MAX_PARTS:
                rows, extra = self.table(name).unionByName(rows.select(*TABLES[name].names)), False
            rows.select(*TABLES[name].names).write.parquet(f"{self.root}/{where}")
            parts[name] = [*(parts.get(name, []) if extra else []), where]
        self.manifest = self.manifest | {"tables": parts, "meta": self.manifest["meta"] | (meta or {})}
        self._publish()

    def meta(self, key: str) -> str | None:
        return self.manifest["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        self.commit(meta={key: value})

    def use_pipeline(self, pipeline: str) -> bool:
        """Whether the index was made by another pipeline. Then the next commit starts from nothing; until it is
        published the old index stands. The first use only notes it."""
        stored = self.meta("pipeline")
        if stored == pipeline:
            return False
        self.manifest = self.manifest | ({"tables": {}, "meta": {"pipeline": pipeline}} if stored is not None else {"meta": self.manifest["meta"] | {"pipeline": pipeline}})
        return stored is not None

    def use_model(self, model: str) -> None:
        """Drops all vectors where another model made them."""
        if self.meta("model") != model:
            self.commit(meta={"model": model}, vectors=self.spark.createDataFrame([], TABLES["vectors"]))

    def _bytes(self, path: str) -> int:
        fs, p = self._fs(path)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def size_bytes(self) -> int:
        """Bytes of the index on disk."""
        return self._bytes(self.root)

    def vacuum(self) -> int:
        """Deletes parts and manifests that aren't in use; the number of parts that went."""
        used = {p for parts in self.manifest["tables"].values() for p in parts}
        gone = 0
        for name in self._list():
            found = _NAME.match(name)
            fs, path = self._fs(f"{self.root}/{name}")
            if name in TABLES:
                for status in fs.listStatus(path):
                    if f"{name}/{status.getPath().getName()}" not in used:
                        fs.delete(status.getPath(), True)
                        gone += 1
            elif name.startswith(".new-") or (found and int(found[1]) < self.number):
                fs.delete(path, False)
        return gone

    def delete_all(self) -> None:
        """Removes the index, and nothing else."""
        for name in [*self._list()]:
            if name in TABLES or _NAME.match(name) or name.startswith((".new-", ".manifest-")):
                fs, path = self._fs(f"{self.root}/{name}")
                fs.delete(path, True)
        self.number, self.manifest = 0, {"schema_version": SCHEMA_VERSION, "tables": {}, "meta": {}}

    def relocate(self, root: str, free_bytes: int | None = None) -> Store:
        """The same index in another folder: copied, checked, published there, and only then removed here."""
        root = root.rstrip("/")
        if free_bytes is not None and free_bytes < self.size_bytes() * 2:
            raise OSError(f"{root} has too little room")
        target = Store(self.spark, root)
        if target.manifest["tables"]:
            raise FileExistsError(f"{root} holds an index")
        copied = {name: self.table(name) for name in self.manifest["tables"]}
        target.commit(meta=dict(self.manifest["meta"]), **copied)
        for name, rows in copied.items():
            if rows.count() != target.table(name).count():
                target.delete_all()
                raise OSError(f"{name} wasn't copied whole")
        self.delete_all()
        return target


def open_or_recover(spark: SparkSession, root: str) -> tuple[Store | None, str]:
    """(index, fine | fresh | cleared | upgraded | rebuilt | newer | away): a damaged index is set aside and a fresh one
    takes its place; a newer one is left untouched and none is given; nor where the folder above can't be reached."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at.getParent()):
        return None, "away"
    try:
        store = Store(spark, root)
        return store, store.outcome
    except NewerIndex:
        return None, "newer"
    except DamagedIndex:
        fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}-damaged-{uuid.uuid4().hex[:8]}"))
        return Store(spark, root), "rebuilt"
