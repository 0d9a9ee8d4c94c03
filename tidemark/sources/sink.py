"""An append-only event log whose small files are put together day by day.

    <root>/date=<d>/part-*              appended, one file per task and day
    <root>/_packed/<run>/date=<d>/part-*  packed
    <root>/_packs/<n>.json              a packing: its run, and the files it replaces

A packing counts once its file in ``_packs`` is there, which one rename brings about.
Before that its files are not read, after that those it replaces are not read, so a
packing that breaks off loses nothing and repeats nothing. Appends may go on meanwhile.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import files
from tidemark.sources.store import Files

_DATE = r"/date=([^/]+)/(?:file=[0-9]+/)?[^/]+$"
# The folder that Spark gives to events without a date.
_UNDATED = "__HIVE_DEFAULT_PARTITION__"


def _nothing(step: str) -> None:
    pass


class EventSink:
    """The log under one folder that all executors share. File names, not rows, pass the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = Files(spark, self.root)

    def append(self, events: DataFrame, timestamp: str = "timestamp") -> None:
        files.append_event_log(events, self.root, timestamp)

    def _packs(self) -> dict[int, dict]:
        numbers = [int(n.removesuffix(".json")) for n in self._files.names(f"{self.root}/_packs") if n.endswith(".json")]
        if not numbers:
            return {}
        texts = self.spark.read.text([f"{self.root}/_packs/{n}.json" for n in numbers], wholetext=True)
        return {p["number"]: p for p in (json.loads(r[0]) for r in texts.collect())}

    def live(self, start: str | None = None, end: str | None = None) -> dict[str, dict[str, int]]:
        """By day the files that count, with their bytes. Names are relative to the root."""
        packs = self._packs().values()
        replaced = {name for p in packs for name in p["replaces"]}
        found: dict[str, dict[str, int]] = defaultdict(dict)
        for base in ["", *[f"_packed/{p['run']}/" for p in packs]]:
            for folder in self._files.names(f"{self.root}/{base}"):
                if not folder.startswith("date="):
                    continue
                day = folder.removeprefix("date=")
                if (start is not None and day < start) or (end is not None and day > end) or (day == _UNDATED and (start or end)):
                    continue
                inner = f"{base}{folder}"
                for place in [f"{inner}/{k}" for k in self._files.names(f"{self.root}/{inner}")] if base else [inner]:
                    sizes = self._files.sizes(f"{self.root}/{place}")
                    found[day].update({f"{place}/{n}": s for n, s in sizes.items() if n.startswith("part-") and f"{place}/{n}" not in replaced})
        return found

    def read(self, schema: str | T.StructType, start: str | None = None, end: str | None = None) -> DataFrame:
        """Events of a range of days (all without one), with their ``date``; other days are not read."""
        paths = [f"{self.root}/{name}" for own in self.live(start, end).values() for name in own]
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*kind.fields, T.StructField("date", T.DateType())]))
        day = F.regexp_extract(F.col("_metadata.file_path"), _DATE, 1).try_cast("date")
        return self.spark.read.schema(kind).option("mode", "DROPMALFORMED").json(paths).withColumn("date", day)

    def pack(self, size: int = 128 << 20, at: Callable[[str], None] = _nothing) -> int:
        """Put files below half of ``size`` bytes together, into files of about ``size``; returns the days packed.

        A day with fewer than two such files stays as it is. Another packing that
        commits first raises ``Conflict``; nothing is lost then, and it may be run
        again. ``at`` is called between the steps.
        """
        small = {day: {n: s for n, s in own.items() if 2 * s < size} for day, own in self.live().items()}
        small = {day: own for day, own in small.items() if len(own) > 1}
        if not small:
            return 0
        number, run = max(self._packs(), default=0) + 1, uuid.uuid4().hex
        paths = [f"{self.root}/{name}" for own in small.values() for name in own]
        lines = self.spark.read.text(paths).select("value", F.regexp_extract(F.col("_metadata.file_path"), _DATE, 1).alias("date"))
        # One row per day: bounded by the calendar.
        wanted = self.spark.createDataFrame([(d, math.ceil(sum(own.values()) / size)) for d, own in small.items()], "day string, files long")
        dealt = lines.join(F.broadcast(wanted), F.col("date") == F.col("day"))
        dealt = dealt.withColumn("file", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("files")))
        # A group of rows is one file, whatever else its task holds.
        total = sum(math.ceil(sum(own.values()) / size) for own in small.values())
        grouped = dealt.repartition(total, "date", "file").select("value", "date", "file")
        grouped.write.partitionBy("date", "file").text(f"{self.root}/_packed/{run}")
        at("written")
        replaces = sorted(name for own in small.values() for name in own)
        self._files.create_once(f"{self.root}/_packs/{number}.json", json.dumps({"number": number, "run": run, "replaces": replaces}))
        at("committed")
        return len(small)

    def vacuum(self) -> None:
        """Delete replaced files and the files of packings that broke off; run it when nothing reads or packs."""
        packs = self._packs().values()
        for name in {name for p in packs for name in p["replaces"]}:
            self._files.delete(f"{self.root}/{name}")
        for run in set(self._files.names(f"{self.root}/_packed")) - {p["run"] for p in packs}:
            self._files.delete(f"{self.root}/_packed/{run}")
