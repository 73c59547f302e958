"""Tables with a commit log: what a run writes counts once a manifest names it.

A run writes its files into a folder of its own, ``_data/_commit=<id>/``, which no reader looks into yet. Then one manifest, a small
file that lists the live folders, is renamed to the next number in ``_log/``. That rename is the commit: before it
readers see the old state, after it the new one, and a crash at any step leaves one of the two. Nothing that a manifest
names is ever changed, so a reader goes on with the state it began with; ``vacuum`` deletes what no state of the last
days needs, folders of crashed runs included. Of two writers that start from one version the second finds its number
taken and starts again from the new state.

Numbers are taken by a rename onto a name that must not exist. HDFS decides such a race; a local file system only
checks beforehand. Plain ``spark.read.parquet`` finds no files in such a table, as names that begin with ``_`` are skipped.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DATA, LOG, COMMIT = "_data", "_log", "_commit"
TRIES = 5


class Conflict(RuntimeError):
    """Another writer has taken the number."""


@dataclass(frozen=True)
class Folder:
    """Files of one partition (its value as text, None for null or an unpartitioned table) with the range of the first key."""

    path: str
    part: str | None
    low: str | None
    high: str | None


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: StructType
    partition: str | None
    key: str | None
    folders: tuple[Folder, ...]


def _step(name: str) -> None:
    """Called after each step of a commit; tests stop a run here."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def _listed(spark: SparkSession, path: str) -> list:
    fs, at = _files(spark, path)
    return list(fs.listStatus(at(path))) if fs.exists(at(path)) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions that are still there, ascending."""
    names = [s.getPath().getName() for s in _listed(spark, f"{path}/{LOG}")]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The manifest of a version (the newest); None where nothing was committed."""
    if version is None:
        there = versions(spark, path)
        if not there:
            return None
        version = there[-1]
    text = spark.read.text(f"{path}/{LOG}/{version:020d}.json", wholetext=True).first()[0]
    m = json.loads(text)
    return Manifest(m["version"], StructType.fromJson(m["schema"]), m["partition"], m["key"], tuple(Folder(**f) for f in m["folders"]))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def _frame(spark: SparkSession, path: str, m: Manifest, folders: list[Folder]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], m.schema)
    return _rows(spark, path, m, [f"{path}/{DATA}/{f.path}" for f in folders])


def _rows(spark: SparkSession, path: str, m: Manifest, places: list[str]) -> DataFrame:
    rows = spark.read.schema(m.schema).option("basePath", f"{path}/{DATA}").parquet(*places)
    return rows.select(*m.schema.names)


def read_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """The rows of some data files of the newest version."""
    return _rows(spark, path, manifest(spark, path), files)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version (the newest)."""
    m = manifest(spark, path, version)
    if m is None:
        raise FileNotFoundError(f"nothing was committed to {path}")
    return _frame(spark, path, m, list(m.folders))


def _stage(spark: SparkSession, path: str, state: DataFrame, partition: str | None, key: str | None) -> list[Folder]:
    """Write ``state`` into a new folder that no manifest names; a row a partition comes to the driver."""
    if COMMIT in state.columns:
        raise ValueError(f"{COMMIT} is a name of the table's own")
    home = f"{COMMIT}={uuid.uuid4().hex}"
    writer = state.write.partitionBy(partition) if partition else state.write
    writer.parquet(f"{path}/{DATA}/{home}")
    _step("files written")
    written = spark.read.schema(state.schema).option("basePath", f"{path}/{DATA}").parquet(f"{path}/{DATA}/{home}")
    part = F.col(partition).cast("string") if partition else F.lit(None).cast("string")
    ends = (F.min(key), F.max(key)) if key else (F.lit(None), F.lit(None))
    ranges = written.groupBy(part.alias("part")).agg(*(e.cast("string").alias(n) for e, n in zip(ends, ("low", "high")))).collect()
    if not partition:
        return [Folder(home, None, r.low, r.high) for r in ranges]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    default = "__HIVE_DEFAULT_PARTITION__"
    names = [s.getPath().getName() for s in _listed(spark, f"{path}/{DATA}/{home}") if s.isDirectory()]
    values = {unescape(n.split("=", 1)[1]): n for n in names if "=" in n}
    return [Folder(f"{home}/{values[default if r.part is None else r.part]}", r.part, r.low, r.high) for r in ranges]


def _commit(spark: SparkSession, path: str, m: Manifest) -> None:
    """Give the manifest its number, or raise Conflict."""
    fs, at = _files(spark, path)
    if m.version == 1 and (plain := [s.getPath().getName() for s in _listed(spark, path) if s.getPath().getName()[0] not in "_."]):
        raise ValueError(f"{path} holds files of a table without a log: {plain[0]}")
    m_json = {"version": m.version, "schema": m.schema.jsonValue(), "partition": m.partition, "key": m.key, "folders": [asdict(f) for f in m.folders]}
    draft, name = at(f"{path}/{LOG}/.{uuid.uuid4().hex}"), at(f"{path}/{LOG}/{m.version:020d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(m_json).encode()))
    out.close()
    _step("manifest written")
    if fs.exists(name) or not fs.rename(draft, name):
        fs.delete(draft, False)
        raise Conflict(f"version {m.version} of {path} is taken")
    _step("manifest named")


def replace(spark: SparkSession, path: str, state: DataFrame, partition: str | None = None, key: str | None = None, base: int | None = None) -> int:
    """Put ``state``, which may read the table, in the place of all rows; the new version's number.

    Whatever others commit meanwhile is replaced too, unless ``base`` names the version (0: none) that the state was made
    from: then a commit between raises Conflict.
    """
    folders = _stage(spark, path, state, partition, key)
    for left in reversed(range(TRIES if base is None else 1)):
        version = 1 + (base if base is not None else max(versions(spark, path), default=0))
        try:
            _commit(spark, path, Manifest(version, state.schema, partition, key, tuple(folders)))
            return version
        except Conflict:
            if not left:
                raise
    raise AssertionError


def change(spark: SparkSession, path: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the table by ``work`` of itself; where another writer comes between, the work is done again on the new state."""
    for left in reversed(range(TRIES)):
        m = manifest(spark, path)
        if m is None:
            raise FileNotFoundError(f"nothing was committed to {path}")
        try:
            return replace(spark, path, work(_frame(spark, path, m, list(m.folders))), m.partition, m.key, m.version)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def _overlapping(spark: SparkSession, m: Manifest, updates: DataFrame) -> list[Folder]:
    """Folders whose range of the first key meets that of the updates; the ranges are compared as values of the key's type."""
    kind = m.schema[m.key].dataType
    rows = [(i, f.low, f.high) for i, f in enumerate(m.folders)]
    ranges = spark.createDataFrame(rows, "i int, low string, high string").select("i", F.col("low").cast(kind).alias("low"), F.col("high").cast(kind).alias("high"))
    span = updates.agg(F.min(m.key).alias("a"), F.max(m.key).alias("b"))
    hit = ranges.crossJoin(F.broadcast(span)).filter("low <= b and high >= a")  # one row
    return [m.folders[r.i] for r in hit.select("i").collect()]


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], partition: str) -> int:
    """Lay ``updates``, of distinct keys, over a table partitioned by ``partition``; the new version's number.

    Only partitions with a row of the updates, or one that an update replaces, are written anew. A row whose partition
    changes is looked for in those alone whose range of keys meets the updates', and of these only the keys are read. ``updates`` is
    read several times, so it had better be a written table; the partitions' values come to the driver. Rows with a null
    key are inserted. A partition that is much larger than others is written by several tasks.
    """
    for left in reversed(range(TRIES)):
        base = manifest(spark, path)
        try:
            if base is None:
                folders = _stage(spark, path, updates.hint("rebalance", partition), partition, keys[0])
                _commit(spark, path, Manifest(1, updates.schema, partition, keys[0], tuple(folders)))
                return 1
            if (base.partition, base.key) != (partition, keys[0]):
                raise ValueError(f"{path} is kept by partition {base.partition} and key {base.key}")
            new, value = updates.select(*keys), F.col(partition).cast("string").alias("part")
            touched = {r.part for r in updates.select(value).distinct().collect()}
            others = [f for f in _overlapping(spark, base, updates) if f.part not in touched]
            if others:
                touched |= {r.part for r in _frame(spark, path, base, others).join(new, keys, "left_semi").select(value).distinct().collect()}
            old = _frame(spark, path, base, [f for f in base.folders if f.part in touched]).join(new, keys, "left_anti")
            state = old.unionByName(updates.select(*base.schema.names)).hint("rebalance", partition)
            folders = _stage(spark, path, state, partition, keys[0])
            kept = tuple(f for f in base.folders if f.part not in touched)
            _commit(spark, path, Manifest(base.version + 1, base.schema, partition, keys[0], kept + tuple(folders)))
            return base.version + 1
        except Conflict:
            if not left:
                raise
    raise AssertionError


def write_partitions(spark: SparkSession, path: str, work: Callable[[DataFrame | None], DataFrame], partition: str, key: str, parts: set[str | None]) -> int:
    """Put ``work`` of the rows of these partitions (values as text; None for a new table) in their place; the new version's number.

    A partition for which ``work`` gives no row goes. Where another writer comes between, the work is done again.
    """
    for left in reversed(range(TRIES)):
        base = manifest(spark, path)
        state = work(_frame(spark, path, base, [f for f in base.folders if f.part in parts]) if base else None)
        folders = tuple(_stage(spark, path, state.hint("rebalance", partition), partition, key))
        if stray := {f.part for f in folders} - parts:
            raise ValueError(f"rows of other partitions: {sorted(map(str, stray))[:3]}")
        kept = tuple(f for f in base.folders if f.part not in parts) if base else ()
        try:
            version = base.version + 1 if base else 1
            _commit(spark, path, Manifest(version, base.schema if base else state.schema, partition, key, kept + folders))
            return version
        except Conflict:
            if not left:
                raise
    raise AssertionError


def vacuum(spark: SparkSession, path: str, keep_hours: float = 168.0) -> int:
    """Delete versions that were replaced more than ``keep_hours`` ago, and folders as old that no other version names.

    Reads and writes that take longer than that would lose their files. Returns how many folders went. A crash leaves
    folders for the next run.
    """
    fs, at = _files(spark, path)
    before = (time.time() - 3600 * keep_hours) * 1000
    logged = sorted((s.getPath().getName(), s.getModificationTime()) for s in _listed(spark, f"{path}/{LOG}") if s.getPath().getName().endswith(".json"))
    old = [name for (name, _), (_, replaced) in zip(logged, logged[1:]) if replaced <= before]
    for name in old:
        fs.delete(at(f"{path}/{LOG}/{name}"), False)
    _step("old versions deleted")
    live = {f.path for v in versions(spark, path) for f in manifest(spark, path, v).folders}
    homes = {p.split("/")[0] for p in live}
    gone = 0
    for home in _listed(spark, f"{path}/{DATA}"):
        name = home.getPath().getName()
        parts = [f"{name}/{s.getPath().getName()}" for s in _listed(spark, f"{path}/{DATA}/{name}") if s.isDirectory()] if name in homes and name not in live else [name]
        for part in parts:
            if part not in live and fs.getFileStatus(at(f"{path}/{DATA}/{part}")).getModificationTime() <= before:
                fs.delete(at(f"{path}/{DATA}/{part}"), True)
                gone += 1
    return gone
