"""Append-only tables that several writers may append to at once, each natural key once.

A commit writes its rows to a folder of its own and then creates the next
manifest file.  A file of that number can be created only once, so of two
writers one wins; the other looks at what has been committed since, takes out
the keys that it finds there and tries again.  Readers see the folders that
manifests name and nothing else, so a writer that dies leaves nothing visible.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import Files

#: Commits of others that one append stands, and manifests after which they are summed up in one.
ATTEMPTS, SUMMED = 100, 50


class Conflict(Exception):
    """Other writers were faster each time."""


@dataclass(frozen=True)
class Commit:
    """Rows of one append: their folder, number, and the first and last value of the date of their keys (as JSON has them)."""

    folder: str
    rows: int
    first: str | None
    last: str | None

    def meets(self, first: str | None, last: str | None) -> bool:
        """Whether it may hold keys of dates between two; null dates are keys of their own that meet nothing."""
        return None not in (self.first, self.last, first, last) and self.first <= last and first <= self.last


class Table:
    """A folder with ``data/<commit>`` and ``manifest/<number>.json``; ``keys`` are unique, the second one is a date."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.manifests = Files(spark, f"{self.path}/manifest")
        self.data = Files(spark, f"{self.path}/data")

    def _numbers(self) -> list[tuple[int, bool]]:
        """(number, whether it sums up all commits up to it) of the manifests."""
        names = [n.removesuffix(".json") for n in self.manifests.names() if n.endswith(".json")]
        return sorted((int(n.removesuffix("-all")), n.endswith("-all")) for n in names)

    def version(self) -> int:
        """The number of commits."""
        return max((n for n, _ in self._numbers()), default=0)

    def commits(self, after: int = 0, upto: int | None = None) -> list[Commit]:
        """The commits of a span of versions, as they were made."""
        known = [x for x in self._numbers() if upto is None or x[0] <= upto]
        whole = max((n for n, all_ in known if all_), default=0)
        found = []
        if whole > after:
            found = [Commit(**c) for c in json.loads(self.manifests.read(f"{whole:08d}-all.json"))][after:]
        for n, all_ in known:
            if not all_ and n > max(whole, after):
                found += [Commit(**c) for c in json.loads(self.manifests.read(f"{n:08d}.json"))]
        return found

    def _date(self, value) -> Column:
        return F.lit(str(value)).cast(self.schema[self.keys[1]].dataType)

    def _frame(self, commits: list[Commit]) -> DataFrame:
        folders = [f"{self.path}/data/{c.folder}" for c in commits if c.rows]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, first=None, last=None) -> DataFrame:
        """The table as of a version (the latest); with dates, rows between these, and commits of other dates aren't opened."""
        commits = self.commits(upto=version)
        date = F.col(self.keys[1])
        if first is None and last is None:
            return self._frame(commits)
        inside = [c for c in commits if c.first is not None and (last is None or c.first <= str(last)) and (first is None or c.last >= str(first))]
        rows = self._frame(inside)
        rows = rows if first is None else rows.filter(date >= self._date(first))
        return rows if last is None else rows.filter(date <= self._date(last))

    def _write(self, rows: DataFrame) -> Commit:
        """Write rows to a folder of their own, that nobody sees yet, and count what was written."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        date = F.col(self.keys[1]).cast("string")
        n, first, last = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").agg(F.count(F.lit(1)), F.min(date), F.max(date)).first()
        return Commit(folder, n, first, last)

    def append(self, rows: DataFrame) -> int:
        """Append the rows whose key isn't stored yet, all of them or none, and return their number.

        Rows with equal keys among ``rows`` are one row; null keys are keys of
        their own, stored each time.  Of the stored rows only those of commits
        with the new rows' dates are read.
        """
        seen = self.version()
        # what is compared and what is stored must be the same rows, so they are written before they are looked at
        draft = self._write(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).dropDuplicates(self.keys))
        own, since = draft, 0
        try:
            for _ in range(ATTEMPTS):
                others = [c for c in self.commits(after=since, upto=seen) if c.rows and c.meets(own.first, own.last)]
                if others:
                    stored = self._frame(others).select(*self.keys).filter(F.col(self.keys[1]).between(self._date(own.first), self._date(own.last)))
                    fresh = self._frame([own]).join(stored, self.keys, "left_anti")
                    own, before = self._write(fresh), own
                    self.data.delete(before.folder)
                since = seen
                if not own.rows:
                    return 0
                if self.manifests.create(f"{seen + 1:08d}.json", json.dumps([vars(own)])):
                    committed, own = own, None
                    if (seen + 1) % SUMMED == 0:
                        self._sum_up(seen + 1)
                    return committed.rows
                seen = self.version()
            raise Conflict(f"{ATTEMPTS} other commits came first")
        finally:
            if own is not None:
                self.data.delete(own.folder)

    def _sum_up(self, version: int) -> None:
        """One manifest for all commits up to a version; the single ones stay, so a reader that has begun goes on."""
        self.manifests.create(f"{version:08d}-all.json", json.dumps([vars(c) for c in self.commits(upto=version)]))

    def clear_drafts(self, older_than_seconds: float = 86_400.0) -> int:
        """Delete the folders that dead writers left; younger ones may belong to a living writer."""
        known = {c.folder for c in self.commits()}
        gone = [n for n in self.data.names() if n not in known and self.data.age_seconds(n) >= older_than_seconds]
        for n in gone:
            self.data.delete(n)
        return len(gone)
