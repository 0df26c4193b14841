"""State tables that several streams and batch jobs change together.

A table is cut into slots by hash of one column (``slot_by``), and every slot into
Spark buckets by its key.  A commit rewrites only the slots that its changed rows fall
into, as new folders of a bucketed table; all other folders, and the files in them, stay as they are.  What belongs to a
version is a list of one folder per slot in ``log/<version>.json``.  Reading a version
registers an external bucketed table with one partition per slot at its
folder, so a join on the key needs no exchange on the state's side.

Writers are optimistic: they compute their changes from the newest version and
put the next entry of the log only if nobody else has put it (a rename that
fails where the target exists, as Spark's own streaming logs do).  Whoever comes
second starts over from the newer version.  An entry also holds the last batch of every writer,
so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stallworks.session import cut_lineage
from stallworks.sources.schedule import RUNS, SHOWS

_LOCAL = threading.Lock()


class Layout(NamedTuple):
    """Columns of a table, its key, and the column that chooses the slot (the same for all versions of a row)."""

    columns: str
    key: str
    slot_by: str


class Change(NamedTuple):
    """Rows to insert or replace, one per key, and (key, slot_by) of rows to delete."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Snapshot(NamedTuple):
    version: int
    tables: dict[str, DataFrame]
    applied: dict[str, int]  #: last batch of every writer


SCHEDULE = {"shows": Layout(SHOWS, "id", "id"), "runs": Layout(RUNS, "id", "show_id")}


class StateStore:
    def __init__(self, spark: SparkSession, path: str, layouts: dict[str, Layout] = SCHEDULE, slots: int = 16, buckets: int = 8) -> None:
        self.spark, self.layouts, self.slots, self.buckets = spark, layouts, slots, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = root.getFileSystem(self._conf)
        self.path = self._fs.makeQualified(root).toString()
        self._tag = hashlib.md5(self.path.encode()).hexdigest()[:12]

    # --- log --------------------------------------------------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("log")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("log"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def entry(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"log/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, version: int, entry: dict) -> bool:
        """Whether this writer was the one to put the version."""
        draft, target = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{version:020d}.json")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft)
        out.write(json.dumps(entry).encode())
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        mode = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.NONE
        try:
            with _LOCAL:  # a local file system checks and renames in two steps
                files.rename(draft, target, modes)
            return True
        except Exception as error:
            self._fs.delete(draft, False)
            if "AlreadyExists" in str(error):
                return False
            raise

    # --- tables -----------------------------------------------------------------

    def slot(self, column: Column | str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.slots)).cast("int").alias("slot")

    def _write(self, name: str, rows: DataFrame, folder: str) -> dict[str, str]:
        """Writes rows as a bucketed table; slot -> folder."""
        layout, table = self.layouts[name], f"state_{uuid.uuid4().hex}"
        place = f"{folder}/{name}"
        placed = rows.withColumn("slot", self.slot(layout.slot_by)).repartition(self.buckets, layout.key)
        (placed.write.format("parquet").partitionBy("slot").bucketBy(self.buckets, layout.key).sortBy(layout.key)
         .option("path", place).saveAsTable(table))
        self.spark.sql(f"DROP TABLE {table}")  # external: its files stay
        parts = [s.getPath() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(place))]
        return {p.getName().removeprefix("slot="): p.toString() for p in parts if p.getName().startswith("slot=")}

    def _registered(self, version: int, name: str, folders: dict[str, str]) -> DataFrame:
        layout, table = self.layouts[name], f"state_{self._tag}_{name}_v{version}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({layout.columns}, slot int) USING parquet PARTITIONED BY (slot) "
                f"CLUSTERED BY ({layout.key}) SORTED BY ({layout.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/none'")
            if folders:
                parts = " ".join(f"PARTITION (slot={k}) LOCATION '{v}'" for k, v in folders.items())
                self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
        return self.spark.table(table)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.layouts[name].columns)))

    def create(self, **tables: DataFrame) -> None:
        """Version 0; does nothing where it is there already."""
        if self.versions():
            return
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        folders = {name: self._write(name, self._shaped(name, tables[name]), folder) for name in self.layouts}
        self._put(0, {"tables": folders, "applied": {}})

    def read(self, version: int | None = None) -> Snapshot:
        """A version, the newest by default, as tables without the slot column."""
        version = self.versions()[-1] if version is None else version
        entry = self.entry(version)
        tables = {name: self._registered(version, name, entry["tables"][name]).drop("slot") for name in self.layouts}
        return Snapshot(version, tables, entry["applied"])

    def commit(self, writer: str, batch: int, step: Callable[[Snapshot], dict[str, Change]], attempts: int = 50) -> int:
        """Applies a step to the newest version and returns the version it made (or found, if the batch was applied before)."""
        for _ in range(attempts):
            now = self.read()
            if now.applied.get(writer, -1) >= batch:
                return now.version
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            folders = self.entry(now.version)["tables"]
            for name, change in step(now).items():
                folders[name] = self._merged(now.version, name, change, folders[name], folder)
            if self._put(now.version + 1, {"tables": folders, "applied": {**now.applied, writer: batch}}):
                return now.version + 1
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)
        raise RuntimeError(f"{writer}: batch {batch} was overtaken {attempts} times")

    def _merged(self, version: int, name: str, change: Change, folders: dict[str, str], folder: str) -> dict[str, str]:
        """Folders of a table after a change: new ones for the slots it touches."""
        layout = self.layouts[name]
        keys = []
        rows = None
        if change.rows is not None:
            rows = cut_lineage(self._shaped(name, change.rows))
            keys.append(rows.select(layout.key, self.slot(layout.slot_by)))
        if change.gone is not None:
            keys.append(cut_lineage(change.gone.select(layout.key, self.slot(layout.slot_by))))
        if not keys:
            return folders
        hit = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
        touched = [r.slot for r in hit.select("slot").distinct().collect()]  # at most all slots
        if not touched:
            return folders
        old = self._registered(version, name, folders).filter(F.col("slot").isin(touched)).drop("slot")
        kept = old.join(hit.select(layout.key).hint("merge"), layout.key, "left_anti")  # a broadcast would give up the buckets
        # what stays lies in its buckets already: only changed rows are shuffled
        merged = kept if rows is None else kept.unionByName(rows.repartition(self.buckets, layout.key))
        written = self._write(name, self._shaped(name, merged), folder)
        return {**{k: v for k, v in folders.items() if int(k) not in touched}, **written}

    def expire(self, keep: int = 10) -> int:
        """Forgets all but the newest versions and deletes the folders that only they held; returns how many."""
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        held = {f for v in new for folders in self.entry(v)["tables"].values() for f in folders.values()}
        dropped = {f for v in old for folders in self.entry(v)["tables"].values() for f in folders.values()} - held
        for version in old:
            for name in self.layouts:
                self.spark.sql(f"DROP TABLE IF EXISTS state_{self._tag}_{name}_v{version}")
            self._fs.delete(self._at(f"log/{version:020d}.json"), False)
        for path in dropped:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
        return len(dropped)
