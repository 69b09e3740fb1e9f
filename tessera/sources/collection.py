"""Collections of points as versioned tables: readers see whole versions, writers add one, and a crash leaves the last one as it was.

A collection is a folder. ``data`` holds segments, Parquet folders that never change; ``gone`` holds lists of ids; ``versions`` holds a manifest
for each version, numbered from 1: the length of its vectors, its segments and lists in the order of writing. A change writes a segment or
a list beside what is there and then renames a manifest to the next number, which fails where another writer was first: it looks at the
new version and tries again. A row is in force if no later list has its id; an upsert is a segment behind a list of its ids. Compaction
writes what is in force anew, sorted by the columns that are filtered by, with Parquet statistics and bloom filters of them, so that scans
skip files and row groups. vacuum() deletes what only older versions use; a reader of such a version is to have ended.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ATTEMPTS = 20


@dataclass(frozen=True)
class Version:
    """A manifest. size: components of its vectors, 0 while it has none. steps: names of segments (data/...) and lists (gone/...) in order."""

    number: int = 0
    size: int = 0
    schema: str = ""
    steps: tuple[str, ...] = field(default_factory=tuple)


def plain(schema) -> str:
    """A schema as JSON with nulls allowed everywhere, as files have it."""

    def free(x):
        if isinstance(x, dict):
            return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else {} if k == "metadata" else free(v) for k, v in x.items()}
        return [free(v) for v in x] if isinstance(x, list) else x

    return json.dumps(free(json.loads(schema.json())), sort_keys=True)


class Conflict(Exception):
    """Another writer made the version first."""


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._hadoop("versions").getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """Numbers of the versions that are there."""
        where = self._hadoop("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def exists(self) -> bool:
        return bool(self.numbers())

    def version(self, number: int | None = None) -> Version:
        """A version by its number, the latest by default; an error where it is not there."""
        known = self.numbers()
        if not known or (number is not None and number not in known):
            raise LookupError(f"{self.path} has no version {'yet' if number is None else number}")
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{number or known[-1]:010d}.json").first()[0]
        return Version(**{k: tuple(v) if k == "steps" else v for k, v in json.loads(text).items()})

    def _commit(self, v: Version) -> Version:
        """Makes v a version; Conflict where its number is taken."""
        beside, place = self._hadoop(f"versions/.{uuid.uuid4().hex}"), self._hadoop(f"versions/{v.number:010d}.json")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(asdict(v)).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf)
        try:
            # unlike FileSystem.rename, this one never takes the place of what is there
            context.rename(beside, place, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(beside, False)
            if self._fs.exists(place):
                raise Conflict(str(place)) from e
            raise
        return v

    def _change(self, make: Callable[[Version], Version]) -> Version:
        for _ in range(ATTEMPTS):
            now = self.version() if self.exists() else Version()
            try:
                return self._commit(replace(make(now), number=now.number + 1))
            except Conflict:
                continue
        raise Conflict(f"{self.path} changed {ATTEMPTS} times meanwhile")

    def ensure(self) -> Version:
        """The latest version; an empty one where there is none."""
        if not self.exists():
            try:
                return self._commit(Version(number=1))
            except Conflict:
                pass
        return self.version()

    def recreate(self) -> Version:
        """A new version without points; older ones can still be read."""
        return self._change(lambda now: Version())

    def _write(self, df: DataFrame, kind: str, **options: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(f"{self.path}/{name}")
        return name

    def upsert(self, points: DataFrame) -> int:
        """Points (point_id, vector, payload) in place of those of their ids; how many. Of rows of one id one stays. All vectors of a collection
        have one length, and all segments one schema."""
        rows = points.where("point_id is not null and vector is not null").dropDuplicates(["point_id"])
        segment = self._write(rows, "data")
        written = self._segment(segment, plain(rows.schema))
        counted = written.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        if not counted["n"]:
            return 0
        if counted["low"] != counted["high"]:
            raise ValueError("vectors of a collection differ in length")
        ids = self._write(written.select("point_id"), "gone")

        def make(now: Version) -> Version:
            if now.size not in (0, counted["low"]):
                raise ValueError(f"the collection's vectors have {now.size} components, new ones {counted['low']}")
            if now.schema not in ("", plain(rows.schema)):
                raise ValueError("the collection's rows have another schema")
            return replace(now, size=counted["low"], schema=plain(rows.schema), steps=(*now.steps, ids, segment) if now.steps else (segment,))

        self._change(make)
        return counted["n"]

    def delete(self, ids: DataFrame) -> Version:
        """Points whose point_id is among the ids go."""
        gone = self._write(ids.select(F.col("point_id").cast("long")).where("point_id is not null").distinct(), "gone")
        return self._change(lambda now: replace(now, steps=(*now.steps, gone)))

    def update(self, where: Column, **payload: Column) -> int:
        """Fields of the payload of points that the condition holds for; how many."""
        new = self.read().where(where)
        for name, value in payload.items():
            new = new.withColumn("payload", F.col("payload").withField(name, value))
        return self.upsert(new)

    def _segment(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.path}/{name}")

    def read(self, number: int | None = None) -> DataFrame:
        """The points of a version, the latest by default. Segments that no later list touches are read as they are; filters reach all scans."""
        v = self.version(number)
        if not v.schema:
            return self.spark.createDataFrame([], "point_id long, vector array<double>, payload struct<id: string>")
        parts = []
        for at, name in enumerate(v.steps):
            if name.startswith("data/"):
                rows = self._segment(name, v.schema)
                later = [n for n in v.steps[at + 1 :] if n.startswith("gone/")]
                if later:
                    rows = rows.join(self.spark.read.schema("point_id long").parquet(*(f"{self.path}/{n}" for n in later)), "point_id", "left_anti").select(rows.columns)
                parts.append(rows)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every

    def count(self) -> int:
        return self.read().count()

    def compact(self, cluster: list[str] | None = None, bloom: list[str] | None = None, distinct: int = 100_000, row_group: int = 16 << 20) -> Version:
        """What is in force as one segment, sorted by range of the cluster columns (fields of the payload as payload.x, or point_id), with bloom
        filters on columns that are looked up by value, for about so many distinct values in a file. Changes made meanwhile are kept on top."""
        before = self.version()
        if not before.schema:
            return before
        keys = cluster or ["point_id"]
        options = {"parquet.block.size": str(row_group)}
        for c in bloom or []:
            options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(distinct)}
        rows = self.read(before.number).repartitionByRange(*keys).sortWithinPartitions(*keys)
        segment = self._write(rows, "data", **options)

        def make(now: Version) -> Version:
            if now.steps[: len(before.steps)] != before.steps:
                raise ValueError("the collection was made anew or compacted meanwhile")
            return replace(now, steps=(segment, *now.steps[len(before.steps) :]))

        return self._change(make)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last ``keep`` versions, and segments and lists that these don't use; names of what went. No writer may be at work."""
        numbers = self.numbers()
        kept = {n for number in numbers[-keep:] for n in self.version(number).steps}
        gone = [f"versions/{n:010d}.json" for n in numbers[:-keep]]
        for kind in ("data", "gone"):
            where = self._hadoop(kind)
            if self._fs.exists(where):
                gone += [f"{kind}/{s.getPath().getName()}" for s in self._fs.listStatus(where) if f"{kind}/{s.getPath().getName()}" not in kept]
        for name in gone:
            self._fs.delete(self._hadoop(name), True)
        return sorted(gone)
