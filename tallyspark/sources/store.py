"""Several tables that change together: data folders and one numbered commit file that names them.

A writer reads the newest commit, writes the tables it changes to folders of its own and then creates the next commit
file, which must not exist: either all tables show their new rows or none does. Who finds that file taken has been
overtaken and writes nothing that a reader sees. A commit lists the folders of every table, so readers need one file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


class Overtaken(RuntimeError):
    """Somebody else has published since the version that a writer started from."""


class Incomplete(RuntimeError):
    """The rows that were written are not those that were expected; nothing is published."""


@dataclass(frozen=True)
class Version:
    """A commit: its number, the folders of each table and what its writer noted. Number 0 is the empty store."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    about: dict = field(default_factory=dict)


class Store:
    """The tables under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{path}/{name}")
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The numbers that are taken, the newest first; a writer that died may have left one without content."""
        folder = self._at("commits")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def load(self, number: int) -> Version | None:
        """A commit, or None if its writer didn't finish it."""
        row = self.spark.read.text(f"{self.path}/commits/{number:012d}.json", wholetext=True).head()
        if row is None or not row[0].endswith("}\n"):
            return None
        found = json.loads(row[0])
        return Version(number, found["folders"], found["about"])

    def head(self, fits: Callable[[Version], bool] = lambda _: True) -> Version:
        """The newest finished commit that fits."""
        return next((v for n in self.numbers() if (v := self.load(n)) and fits(v)), Version())

    def read(self, version: Version, table: str, like: DataFrame | None = None) -> DataFrame:
        """A table's rows in a version; `like` gives the columns of a table that isn't there yet."""
        folders = version.folders.get(table)
        if folders:
            return self.spark.read.option("mergeSchema", "true").parquet(*folders)
        if like is None:
            raise KeyError(table)
        return like.limit(0)

    def write(self, df: DataFrame, table: str, by: list[str] | None = None) -> str:
        """Write rows to a new folder, which no reader sees before a commit names it."""
        folder = f"{self.path}/data/{table}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(folder)
        return folder

    def commit(self, taken: int, folders: dict[str, list[str]], about: dict | None = None) -> Version:
        """Publish: create the commit behind `taken`, the newest number when the writer began; Overtaken if it is there."""
        text = json.dumps({"folders": folders, "about": about or {}}) + "\n"
        try:
            out = self._files.create(self._at(f"commits/{taken + 1:012d}.json"), False)
        except Exception as error:
            if taken + 1 in self.numbers():
                raise Overtaken(f"version {taken + 1} of {self.path} was published meanwhile") from error
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return Version(taken + 1, folders, about or {})

    def begin(self) -> tuple[int, Version]:
        """The newest number that is taken and the newest finished version, for commit()."""
        numbers = self.numbers()
        return (numbers[0] if numbers else 0), self.head()

    def expire(self, keep: int = 2) -> list[str]:
        """Delete commits but for the newest `keep` finished ones, and the data folders that those don't name."""
        kept: list[Version] = []
        for n in self.numbers():
            if len(kept) < keep and (found := self.load(n)):
                kept.append(found)
            elif len(kept) == keep:
                self._files.delete(self._at(f"commits/{n:012d}.json"), False)
        named = {f.split("/data/", 1)[1].split("/", 1)[0] for v in kept for folders in v.folders.values() for f in folders}
        data = self._at("data")
        gone = [s.getPath().getName() for s in self._files.listStatus(data) if s.getPath().getName() not in named] if self._files.exists(data) else []
        for name in gone:
            self._files.delete(self._at(f"data/{name}"), True)
        return gone


def publish_complete(store: Store, table: str, df: DataFrame, expected: int, unknown: Column) -> Version:
    """A4: publish df as the table if it has `expected` rows and none is unknown; else Incomplete, and the version before
    stays. The counts are taken while the rows are written, so the source is read once."""
    taken, version = store.begin()
    seen = Observation()
    folder = store.write(df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(unknown, F.lit(False))).alias("u")), table)
    if (seen.get["n"], seen.get["u"]) != (expected, 0):
        raise Incomplete(f"{table}: {seen.get['n']} rows of {expected}, {seen.get['u']} unknown")
    return store.commit(taken, version.folders | {table: [folder]}, {"table": table, "n": expected})


def replace_days(store: Store, batches: dict[str, DataFrame], day: str, low: Column, high: Column, stamp: Column, refresh: str, legacy: dict[str, DataFrame] | None = None) -> Version:
    """In all tables at once, the rows of the days low to high go to the archive and the batches take their place.

    batches has a table of rows for each name; `day` is a date. A batch row outside the range or without a day stops it
    before anything is published. Every day of the range is marked in refreshed_days, also for empty batches. legacy has
    rows of earlier files to take in once: those of days that are neither in the range nor marked before. The archive has
    the rows that went, as JSON, with `refresh` and the name of their table. The version's notes tell how many rows went
    and came.
    """
    taken, version = store.begin()
    inside = F.coalesce(F.col(day).between(low, high), F.lit(False))
    folders, about, retired = dict(version.folders), {"refresh": refresh}, []
    marked = store.read(version, "refreshed_days", store.spark.range(0).select(low.alias(day), stamp.alias("refreshed_at")))
    for name, batch in batches.items():
        old = store.read(version, name, batch)
        kept = old.where(~inside)
        if legacy and name in legacy:
            kept = kept.unionByName(legacy[name].where(~inside).join(marked.select(day).distinct(), day, "left_anti"), allowMissingColumns=True)
        checked = batch.where(F.when(~inside, F.raise_error(F.lit("a row is outside the range"))).otherwise(F.lit(True)))
        came, went = Observation(), Observation()
        rows = kept.unionByName(checked.observe(came, F.count(F.lit(1)).alias("n")), allowMissingColumns=True)
        folders[name] = [store.write(rows, name)]
        gone = old.where(inside).observe(went, F.count(F.lit(1)).alias("n"))
        retired.append((name, came, went, store.write(gone.select(F.lit(refresh).alias("refresh"), F.lit(name).alias("dataset"), F.to_json(F.struct(*old.columns)).alias("row")), "archive")))
    days = store.spark.range(1).select(F.explode(F.sequence(low, high)).alias(day), stamp.alias("refreshed_at"))
    folders["refreshed_days"] = [*folders.get("refreshed_days", []), store.write(days, "refreshed_days")]
    folders["archive"] = [*folders.get("archive", []), *(r[3] for r in retired)]
    about |= {f"{name}_{kind}": seen.get["n"] for name, came, went, _ in retired for kind, seen in (("came", came), ("went", went))}
    return store.commit(taken, folders, about)
