"""A table of the latest row of each key that is changed batch by batch and stays bounded.

A batch adds one folder of changed rows, a *segment*. Once ``fan`` segments stand on a level they are
merged, inside the batch, into one of the next level, so that after n batches there are at most
``fan - 1`` segments on each of some log(n) levels, and a row is written again log(n) times. What
the table consists of after a batch is listed in a small file named by the batch, which appears by one
rename: readers see all of a batch or nothing, and may name an earlier batch to read. Lists of the last
``keep`` batches are kept, with the segments they name; the rest is removed.

Rows have a ``part``: a coarse value that follows from the key (a month, say) and a hash bucket. A segment with rows
enough has a folder for each part; in a smaller one parts share folders by their hash, so that files follow
the rows, not the number of parts. Keys carry Parquet Bloom filters. A lookup reads keys and versions of the
folders of the parts in question first, and whole rows only of those where something was found.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.session import settle
from weirlog.streaming.sinks import claim, hadoop_path

PART, SEGMENT = "part", "segment"
#: Folders that are named in a scan's filter; with more, the scan is not narrowed by them.
NAMED_PARTS = 4096
#: Rows for each folder of a segment, on average. Where parts would have fewer, they share folders.
FOLDER_ROWS = 1 << 18
_LIST = "rows-after-"


@dataclass(frozen=True)
class KeyedTable:
    """``version`` rises with every change of a key. A part should be some hundred megabytes: choose ``buckets`` by the
    rows of a coarse value. ``coarse`` is SQL over the key's columns and those that
    follow from it. ``done`` is SQL for rows that may be forgotten once nothing older is stored of their key."""

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    version: str
    coarse: str = "'all'"
    done: str = "false"
    buckets: int = 4
    fan: int = 4
    keep: int = 4

    @property
    def part(self) -> str:
        return f"concat({self.coarse}, '-', pmod(xxhash64({', '.join(self.keys)}), {self.buckets}))"

    def _folder(self, name: str) -> str:
        return f"{self.root}/segments/{SEGMENT}={name}"

    @staticmethod
    def _shared(groups: int) -> str:
        """SQL for the folder of a part where parts share that many. Rows without a part, which no lookup finds, stay apart."""
        return f"if({PART} is null, null, concat('~{groups}-', pmod(xxhash64({PART}), {groups})))"

    # --- lists of segments ------------------------------------------------------------------

    def _lists(self, spark: SparkSession) -> dict[int, str]:
        files, at = hadoop_path(spark, f"{self.root}/{_LIST}*.json")
        found = [s.getPath() for s in files.globStatus(at) or []]
        return {int(p.getName().removeprefix(_LIST).removesuffix(".json")): p.toString() for p in found}

    def _read_list(self, spark: SparkSession, path: str) -> dict:
        files, at = hadoop_path(spark, path)
        stream = files.open(at)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def batches(self, spark: SparkSession) -> list[int]:
        """The batches whose state can be read."""
        return sorted(self._lists(spark))

    def segments(self, spark: SparkSession, batch: int | None = None, before: int | None = None) -> list[dict]:
        """What the table consists of: now, after a batch, or before one. A state whose list was removed is refused."""
        lists = self._lists(spark)
        if batch is None:
            earlier = [b for b in lists if before is None or b < before]
            if not earlier:
                first = self._read_list(spark, lists[min(lists)]) if lists else {"follows": None}
                if first["follows"] is not None:
                    raise LookupError(f"{self.root} keeps its states from batch {min(lists)} on, none before batch {before}")
                return []
            batch = max(earlier)
        if batch not in lists:
            raise LookupError(f"{self.root} keeps no state after batch {batch}, but {sorted(lists)}")
        return self._read_list(spark, lists[batch])["segments"]

    def _publish(self, spark: SparkSession, batch: int, segments: list[dict]) -> None:
        follows = max((b for b in self._lists(spark) if b < batch), default=None)
        files, unseen = hadoop_path(spark, f"{self.root}/_{uuid.uuid4().hex}")
        out = files.create(unseen, False)
        out.write(bytearray(json.dumps({"follows": follows, "segments": segments}).encode()))
        out.close()
        if not files.rename(unseen, hadoop_path(spark, f"{self.root}/{_LIST}{batch}.json")[1]):
            raise RuntimeError(f"batch {batch} of {self.root} was stored by someone else meanwhile")

    def _tidy(self, spark: SparkSession) -> None:
        """Remove lists beyond the last ``keep``, and segments that no list names, those of failed attempts included."""
        lists = self._lists(spark)
        for batch in sorted(lists)[: -self.keep]:
            files, at = hadoop_path(spark, lists.pop(batch))
            files.delete(at, False)
        named = {s["name"] for path in lists.values() for s in self._read_list(spark, path)["segments"]}
        files, at = hadoop_path(spark, f"{self.root}/segments/*")
        for status in files.globStatus(at) or []:
            if status.getPath().getName().removeprefix(f"{SEGMENT}=") not in named:
                files.delete(status.getPath(), True)

    # --- reading ----------------------------------------------------------------------------

    def _rows(self, spark: SparkSession, segments: list[dict]) -> DataFrame:
        """All stored rows, with the folder they are in as ``part``."""
        schema = T.StructType([*self.schema.fields, T.StructField(PART, T.StringType())])
        if not segments:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(SEGMENT, T.StringType())]))
        paths = [self._folder(s["name"]) for s in segments]
        return reader.option("basePath", f"{self.root}/segments").parquet(*paths).select(*schema.names)

    def _latest(self, rows: DataFrame) -> DataFrame:
        # a key's rows may be in unlike folders of different segments
        rest = ", ".join(f"`{c}`" for c in rows.columns if c not in (*self.keys, PART))
        newest = rows.groupBy(*self.keys, F.isnull(PART)).agg(F.expr(f"max_by(struct({rest}), `{self.version}`) as _row"))
        return newest.select(*self.keys, "_row.*")

    def read(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """The table as it is now, or as it was after a batch."""
        return self.rows_of(spark, self.segments(spark, batch))

    def rows_of(self, spark: SparkSession, segments: list[dict]) -> DataFrame:
        """The latest rows in some segments."""
        latest = self._latest(self._rows(spark, segments))
        return latest.where(f"not ({self.done})").select(*self.schema.names)

    def get(self, spark: SparkSession, *key: object) -> DataFrame:
        """The row of one key. Bloom filters spare the files that don't have it."""
        rows = self._rows(spark, self.segments(spark))
        for name, value in zip(self.keys, key, strict=True):
            rows = rows.where(F.col(name) == F.lit(value))
        return self._latest(rows).select(*self.schema.names)

    def versions(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """(keys, part, version) of those of the ``wanted`` rows that are stored; reads no other column."""
        spark = wanted.sparkSession
        wanted = wanted.selectExpr(*self.keys, f"{self.part} as {PART}").where(f"{PART} is not null").distinct()
        segments = self.segments(spark, before=before)
        rows = self._narrowed(self._rows(spark, segments).select(*self.keys, PART, self.version), wanted, segments)
        found = rows.drop(PART).join(wanted, list(self.keys))
        return found.groupBy(*self.keys, PART).agg(F.max(self.version).alias(self.version))

    def find(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The stored rows of the keys of ``wanted``, as before a batch."""
        spark = wanted.sparkSession
        found = settle(self.versions(wanted, before))
        segments = self.segments(spark, before=before)
        rows = self._narrowed(self._rows(spark, segments), found, segments)
        # a version of a key is stored once
        return rows.join(found, [*self.keys, self.version], "left_semi").select(*self.schema.names)

    def _narrowed(self, rows: DataFrame, by: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows in the folders of the parts that occur in ``by``, as a filter that keeps the others' files from being opened."""
        shared = [self._shared(n) for n in sorted({s["groups"] for s in segments if s.get("groups")})]
        names = by.select(PART).distinct().selectExpr(f"explode(array({', '.join([PART, *shared])})) as name")
        folders = [r[0] for r in names.distinct().limit(NAMED_PARTS + 1).collect()]
        return rows.where(F.col(PART).isin(folders) if len(folders) <= NAMED_PARTS else F.isnotnull(PART))

    # --- writing ----------------------------------------------------------------------------

    def _write(self, rows: DataFrame, batch: int, level: int, count: int, parts: int) -> list[dict]:
        """A new segment, or none where there are no rows. ``count`` rows and ``parts`` are the most there may be."""
        name = f"{batch}-{level}-{uuid.uuid4().hex}"
        # powers of two, so that the segments of a table have few numbers of folders
        groups = 1 << max(0, (count // FOLDER_ROWS).bit_length() - 1)
        groups = 0 if groups >= parts else groups
        rows = rows.selectExpr("*", f"{self.part} as {PART}")
        if groups:
            rows = rows.withColumn(PART, F.expr(self._shared(groups)))
        writer = rows.hint("rebalance", PART).sortWithinPartitions(PART, *self.keys).write.partitionBy(PART)
        for key in self.keys:
            # a dictionary would stand in for the filter, at the size of the keys
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.enable.dictionary#{key}", "false")
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(self._folder(name))
        files, at = hadoop_path(rows.sparkSession, f"{self._folder(name)}/{PART}=*")
        found = {"name": name, "level": level, "rows": count, "parts": parts, "groups": groups}
        return [found] if files.globStatus(at) else []

    def change(self, rows: DataFrame, batch: int) -> None:
        """Store the changed rows of a batch, one per key, unless an earlier attempt did so."""
        spark = rows.sparkSession
        claim(spark, self.root)
        if batch in self._lists(spark):
            return
        segments = self.segments(spark, before=batch)
        changed = rows.select(*self.schema.names).persist()
        try:
            parts = changed.selectExpr(f"{self.part} as {PART}").groupBy(PART).agg(F.count("*").alias("n"))
            size = parts.agg(F.sum("n").alias("n"), F.count("*").alias("parts")).first()
            segments += self._write(changed, batch, 0, size.n, size.parts) if size.n else []
        finally:
            changed.unpersist()
        level = 0
        while len(full := [s for s in segments if s["level"] == level]) >= self.fan:
            segments = [s for s in segments if s["level"] != level]
            merged = self._latest(self._rows(spark, full))
            if not any(s["level"] > level for s in segments):
                merged = merged.where(f"not ({self.done})")
            level += 1
            # segments of tables begun before these were noted have a folder for each part
            noted = all("rows" in s for s in full)
            count, parts = (sum(s[c] for s in full) for c in ("rows", "parts")) if noted else (0, 0)
            segments += self._write(merged, batch, level, count, parts)
        self._publish(spark, batch, segments)
        self._tidy(spark)
