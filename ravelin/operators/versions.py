"""A store of several tables whose changes become visible together.

The log holds one small file for each version of the store.  It names, for
every table, the folders that make it up: a base, and the changes since.  A
change is written as new folders under names of their own, and its version's
file then appears under the next number, which only one writer can take: a
writer that began at an older version fails (``Conflict``) and may begin anew
at the newest one.  A crash leaves folders that no version names.  Readers keep
the version that they opened; another process that opens the path finds all.

A change file holds the new rows of the keys that it touches and a mark for
those that have no rows any more.  A reader takes of every key the rows of the
last change that names it, and of the base those that no change names; so what
a change writes doesn't grow with the table.  A table of sums holds signed
amounts instead, which a reader adds up, so that changes commute.  When changes
have grown to half of the base (or to many), they are folded into a new base, in as many
buckets as its size asks for: every row is rewritten a bounded number of times
for each doubling.
"""

from __future__ import annotations

import copy
import json
import random
import threading
import time
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ravelin.operators.store import broken_keys, merged
from ravelin.scratch import Scratch, file_system

T = TypeVar("T")

#: Bytes of a bucket from which a table gets more of them, bytes of changes that are worth folding, and changes that a table has at most before they are.
BUCKET_BYTES, FOLD_BYTES, MOST_CHANGES = 256 << 20, 16 << 20, 50
_TAKING = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has made the version that this one would have been."""


def _same(left: DataFrame | None, keys: list[str], names: list[str]) -> Column:
    """Equality of keys in which nulls are equal."""
    return reduce(and_, ((F.col(k) if left is None else left[k]).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))


class Snapshots:
    """Named tables under a path (without one: temporary), in ``buckets`` folders each at first."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.root = path.rstrip("/") if path else Scratch(spark).root

    # --- versions ---

    def _named(self, path: str) -> list[str]:
        at, fs = file_system(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._named(f"{self.root}/log") if n.isdigit())

    def version(self) -> int:
        """The newest version; 0 of an empty store."""
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> dict:
        """What a version (the newest) names: ``tables`` and ``properties``."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "properties": {}}
        path, fs = file_system(self.spark, f"{self.root}/log/{version:012d}")
        held = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    def take(self, version: int, state: dict) -> None:
        """Make ``state`` the store's version of this number, if there is none yet."""
        final, fs = file_system(self.spark, f"{self.root}/log/{version:012d}")
        draft, _ = file_system(self.spark, f"{self.root}/drafts/{uuid.uuid4().hex}")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        with _TAKING:  # a local file system looks first and renames then
            try:
                files.rename(fs.makeQualified(draft), fs.makeQualified(final), how)  # never onto a file that is there
            except Exception as error:
                fs.delete(draft, False)
                if self.made(version, state):
                    return  # done, though it was reported otherwise
                if fs.exists(final):
                    raise Conflict(f"version {version} was made by another writer") from error
                raise

    def made(self, version: int, state: dict) -> bool:
        """Whether a version is the one that ``state`` was to be."""
        path, fs = file_system(self.spark, f"{self.root}/log/{version:012d}")
        return bool(state.get("change")) and fs.exists(path) and self.state(version).get("change") == state["change"]

    def begin(self) -> Change:
        return Change(self)

    def commit(self, change: Callable[[Change], T], tries: int = 5) -> T:
        """Apply ``change`` to the newest version and make the next one of it; where another writer was faster, anew."""
        for left in reversed(range(tries)):
            made = self.begin()
            try:
                out = change(made)
                made.commit()
            except Conflict:
                made.discard()
                if not left:
                    raise
                time.sleep(random.uniform(0, 0.2))
                continue
            except BaseException:
                made.discard()
                raise
            for name in made.touched:
                self._maintain(name, made.state["tables"].get(name))
            return out
        raise ValueError("tries must be positive")

    # --- reading ---

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as it is in a version (the newest); None where there is none."""
        table = self.state(version)["tables"].get(name)
        return self.open(name, table) if table else None

    def property(self, name: str):
        return self.state()["properties"].get(name)

    def _parts(self, name: str, table: dict, parts: list[str], buckets: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(table["schema"]).add("_gone", "boolean").add("_part", "string").add("_bucket", "integer")
        if not parts:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.root}/data/{name}"
        rows = self.spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/_part={p}" for p in parts))
        return rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))

    def open(self, name: str, table: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table as a version names it, or of some of its buckets alone."""
        keys, columns = table["keys"], StructType.fromJson(table["schema"]).names
        base, parts = self._parts(name, table, table["base"], buckets), [c["part"] for c in table["changes"]]
        if table["kind"] == "sums":
            amounts = [c for c in columns if c not in keys]
            rows = self._parts(name, table, table["base"] + parts, buckets)
            added = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in amounts))
            return added.where(" OR ".join(f"`{c}` <> 0" for c in amounts)).select(*columns)
        if not parts:
            return base.select(*columns)
        since = self._parts(name, table, parts, buckets)
        named = [f"_{k}" for k in keys]
        last = since.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True))).agg(F.max("_part").alias("_last"))
        kept = base.join(last, _same(None, keys, named), "left_anti").select(*columns)
        newest = since.join(last, _same(None, keys, named) & (F.col("_part") == F.col("_last"))).where("NOT _gone").select(*columns)
        return kept.unionByName(newest)

    # --- single changes ---

    def write(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``rows`` as the whole table."""
        self.commit(lambda c: c.write(name, rows, keys))
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
        """Merge rows into the table, of each key the one with the largest ``seq``."""
        self.commit(lambda c: c.upsert(name, rows, keys, seq))
        return self.read(name)

    def replace(self, name: str, rows: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
        """``rows`` in place of all rows with keys in ``given``, which holds the keys of ``rows``."""
        self.commit(lambda c: c.put(name, rows, given, keys))
        return self.read(name)

    # --- upkeep ---

    def _maintain(self, name: str, table: dict | None) -> None:
        """Fold a table that was just changed, if its changes have grown enough."""
        if table is None:
            return
        size = sum(c["bytes"] for c in table["changes"])
        if len(table["changes"]) > MOST_CHANGES or size >= max(FOLD_BYTES, table["bytes"] / 2):
            try:
                self.fold(name, tries=1)
            except Conflict:
                pass  # the other writer will come by here

    def fold(self, name: str, tries: int = 5) -> None:
        """A new base of the base and all changes, in as many buckets as its size asks for."""

        def folded(change: Change) -> None:
            table = change.state["tables"][name]
            size = table["bytes"] + sum(c["bytes"] for c in table["changes"])
            while size > table["buckets"] * BUCKET_BYTES:
                table["buckets"] *= 2
            change.write(name, self.open(name, table), table["keys"], table.get("unique"))

        for left in reversed(range(tries)):
            made = self.begin()
            try:
                folded(made)
                return made.commit()
            except Conflict:
                made.discard()
                if not left:
                    raise

    def expire(self, keep: int = 2, grace: float = 86_400) -> None:
        """Delete all but the newest ``keep`` versions, and folders older than ``grace`` seconds (changes that are being written are younger) that none of these names."""
        every = self.versions()
        kept = every[-keep:]
        used = {(n, p) for v in kept for n, t in self.state(v)["tables"].items() for p in [*t["base"], *(c["part"] for c in t["changes"])]}
        for v in every[:-keep]:
            path, fs = file_system(self.spark, f"{self.root}/log/{v:012d}")
            fs.delete(path, False)
        for name in self._named(f"{self.root}/data"):
            for part in self._named(f"{self.root}/data/{name}"):
                path, fs = file_system(self.spark, f"{self.root}/data/{name}/{part}")
                old = time.time() - fs.getFileStatus(path).getModificationTime() / 1000 >= grace
                if old and (name, part.removeprefix("_part=")) not in used:
                    fs.delete(path, True)

    def health(self) -> DataFrame:
        """For every table: version, numbers of rows, columns and broken unique keys, changes since the base, what fails if it can't be read, and the store's path and embeddings."""
        rows, version, state = [], self.version(), self.state()
        given = state["properties"].get("embedding") or {}
        for name, table in sorted(state["tables"].items()):
            n = columns = broken = error = None
            try:
                held = self.open(name, table)
                n, columns = held.count(), len(held.columns)
                broken = broken_keys(held, table["unique"]).count() if table.get("unique") else 0
            except Exception as failed:  # a table that can't be read mustn't hide the others
                error = type(failed).__name__
            rows.append((name, version, n, columns, broken, len(table["changes"]), error, self.root, given.get("provider"), given.get("dimension")))
        return self.spark.createDataFrame(rows, "name string, version int, n_rows bigint, n_columns int, n_broken_keys bigint, n_changes int, error string, path string, provider string, dimension int")


class Change:
    """What a writer does to some tables of a store before it makes a version of it."""

    def __init__(self, store: Snapshots):
        self.store, self.base = store, store.version()
        self.state = copy.deepcopy(store.state(self.base)) | {"change": uuid.uuid4().hex}
        self.touched: list[str] = []
        self._made: list[str] = []

    def read(self, name: str) -> DataFrame | None:
        """A table with what was done to it so far."""
        table = self.state["tables"].get(name)
        return self.store.open(name, table) if table else None

    def lookup(self, name: str, ids: DataFrame) -> DataFrame | None:
        """The rows of a table whose keys are in ``ids``; only the buckets that can hold them are read."""
        table = self.state["tables"].get(name)
        if not table:
            return None
        keys, named = table["keys"], [f"_{k}" for k in table["keys"]]
        wanted = ids.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True))).distinct()
        buckets = [r[0] for r in wanted.select(self._bucket(named, table["buckets"])).distinct().collect()]  # at most as many as buckets
        return self.store.open(name, table, buckets).join(wanted, _same(None, keys, named), "left_semi")

    def set(self, name: str, value) -> None:
        """Set a property of the store."""
        self.state["properties"][name] = value

    @staticmethod
    def _bucket(keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")

    def _table(self, name: str, rows: DataFrame, keys: list[str], kind: str, unique: list[str] | None) -> dict:
        """The table's part of the state; what is given must suit it."""
        schema = json.loads(rows.schema.json())
        for field in schema["fields"]:
            field["nullable"] = True
        table = self.state["tables"].get(name)
        if table is None:
            table = self.state["tables"][name] = {"schema": schema, "keys": keys, "kind": kind, "unique": unique, "buckets": self.store.buckets, "base": [], "bytes": 0, "changes": []}
        if table["keys"] != keys or table["kind"] != kind:
            raise ValueError(f"{name} is a table of {table['kind']} by {table['keys']}")
        if StructType.fromJson(table["schema"]).names != StructType.fromJson(schema).names:
            raise ValueError(f"{name} has the columns {StructType.fromJson(table['schema']).names}")
        return table

    def _written(self, name: str, table: dict, rows: DataFrame) -> dict:
        """A new folder of rows (with _gone), its name and size."""
        part = f"{self.base + 1:012d}-{len(self._made):04d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.store.root}/data/{name}/_part={part}"
        self._made.append(folder)
        dealt = rows.withColumn("_bucket", self._bucket(table["keys"], table["buckets"])).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(folder)
        path, fs = file_system(self.store.spark, folder)
        if name not in self.touched:
            self.touched.append(name)
        return {"part": part, "bytes": fs.getContentSummary(path).getLength()}

    def write(self, name: str, rows: DataFrame, keys: list[str], unique: list[str] | None = None) -> None:
        """``rows`` as the whole table."""
        old = self.state["tables"].pop(name, None)
        table = self._table(name, rows, keys, old["kind"] if old else "rows", unique)
        table["buckets"] = old["buckets"] if old else self.store.buckets
        made = self._written(name, table, rows.withColumn("_gone", F.lit(False)))
        table["base"], table["bytes"], table["changes"] = [made["part"]], made["bytes"], []

    def put(self, name: str, rows: DataFrame, given: DataFrame, keys: list[str], unique: list[str] | None = None) -> None:
        """``rows`` in place of all rows with keys in ``given``, which holds the keys of ``rows``."""
        table = self._table(name, rows, keys, "rows", unique)
        if not table["base"] and not table["changes"]:
            return self.write(name, rows, keys, unique)
        named = [f"_{k}" for k in keys]
        have = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True))).distinct()
        bare = given.select(*keys).distinct().join(have, _same(None, keys, named), "left_anti").withColumn("_gone", F.lit(True))
        marked = rows.withColumn("_gone", F.lit(False)).unionByName(bare, allowMissingColumns=True)
        table["changes"].append(self._written(name, table, marked))

    def upsert(self, name: str, rows: DataFrame, keys: list[str], seq: str = "seq") -> None:
        """Of each key the row with the largest ``seq``, of those given and the one that is stored."""
        old = self.lookup(name, rows)
        best = merged(rows if old is None else old.unionByName(rows), keys, seq)
        self.put(name, best, best, keys, keys)

    def add(self, name: str, amounts: DataFrame, keys: list[str]) -> None:
        """Signed amounts for keys, to be added to what a table of sums holds."""
        table = self._table(name, amounts, keys, "sums", keys)
        table["changes"].append(self._written(name, table, amounts.withColumn("_gone", F.lit(False))))

    def drop(self, name: str) -> None:
        self.state["tables"].pop(name, None)

    def commit(self) -> None:
        """Make this the store's next version, or fail if another one was made since it began."""
        self.store.take(self.base + 1, self.state)

    def discard(self) -> None:
        """Delete what was written for a version that wasn't made; one that was, in spite of an error, keeps it."""
        if self.store.made(self.base + 1, self.state):
            return
        for folder in self._made:
            path, fs = file_system(self.store.spark, folder)
            fs.delete(path, True)
