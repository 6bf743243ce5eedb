"""Stored tables: slices in folders of their own, versions, and a list that says which folder holds which slice.

A slice (a month, a bucket of keys) is an expression over the key columns, so a key stays where it is. A write stages its rows once, finds the
slices that they touch, merges these alone, writes them to a folder of this version, and then names them in a new list; the files
of all other slices stay as they are. Lists are numbered and made by one rename, so a reader sees a write whole or not at all, a
writer that dies leaves folders that no list names, and of two writers at once the second fails and can be run again.

Empty writes change nothing. A null slice is one of its own. Repeated keys in the new rows are the merge's affair; all of meridia.operators.upsert keep
one row a key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .workspace import _path, discard, exists, remove, written

Merge = Callable[[DataFrame, DataFrame], DataFrame]
_SLICE = "_slice"


def by_month(date: str) -> Column:
    return F.date_format(date, "yyyy-MM")


def by_bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("string")


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, slice_of: Column):
        self.spark, self.path, self.slice_of = spark, path.rstrip("/"), slice_of

    # lists

    def _lists(self) -> list[int]:
        store, at = _path(self.spark, f"{self.path}/lists")
        if not store.exists(at):
            return []
        names = [f.getPath().getName() for f in store.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _list(self, number: int | None = None) -> dict:
        numbers = self._lists()
        if not numbers:
            return {"number": 0, "schema": None, "slices": {}}
        number = numbers[-1] if number is None else number
        return json.loads(self.spark.read.text(f"{self.path}/lists/{number}.json", wholetext=True).first().value)

    def _publish(self, before: dict, schema: StructType, slices: dict[str, list[str]]) -> None:
        number = before["number"] + 1
        text = json.dumps({"number": number, "schema": schema.jsonValue(), "slices": slices}, sort_keys=True)
        store, draft = _path(self.spark, f"{self.path}/lists/.{number}-{uuid.uuid4().hex}")
        stream = store.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        final = _path(self.spark, f"{self.path}/lists/{number}.json")[1]
        if store.exists(final) or not store.rename(draft, final):
            store.delete(draft, False)
            raise RuntimeError(f"{self.path}: another write was first; run this one again")

    # reading

    def exists(self) -> bool:
        return bool(self._lists())

    def slices(self) -> list[str]:
        return sorted(self._list()["slices"])

    def read(self, slices: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The rows, of some slices if given, of an earlier list if given. Other slices' files are not opened."""
        known = self._list(number)
        if known["schema"] is None:
            raise ValueError(f"nothing has been stored at {self.path}")
        schema = StructType.fromJson(known["schema"])
        folders = sorted(f for s, own in known["slices"].items() if slices is None or s in slices for f in own)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # writing

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        staged = written(rows.withColumn(_SLICE, F.coalesce(self.slice_of, F.lit("null"))), "staged")
        return staged, sorted(r[0] for r in staged.select(_SLICE).distinct().collect())

    def _write(self, rows: DataFrame, number: int, slices: list[str]) -> dict[str, str]:
        """The folder of each slice that rows have."""
        folder = f"{self.path}/versions/{number}-{uuid.uuid4().hex}"
        rows.hint("rebalance", _SLICE).write.partitionBy(_SLICE).option("compression", "zstd").parquet(folder)
        made = {s: f"{folder}/{_SLICE}={s}" for s in slices}
        return {s: f for s, f in made.items() if exists(self.spark, f)}

    def merge(self, new: DataFrame, how: Merge) -> list[str]:
        """Rewrites the slices that new touches as how(their old rows, new) and gives their names. New columns are not added to a stored table."""
        before = self._list()
        staged, touched = self._staged(new)
        if touched or before["schema"] is None:
            rows = staged.drop(_SLICE)
            old = self.read(touched) if before["schema"] is not None else self.spark.createDataFrame([], new.schema)
            merged = how(old, rows).select(*old.columns)
            made = self._write(merged.withColumn(_SLICE, F.coalesce(self.slice_of, F.lit("null"))), before["number"] + 1, touched)
            others = {s: f for s, f in before["slices"].items() if s not in touched}
            self._publish(before, merged.schema, others | {s: [f] for s, f in made.items()})
        discard(staged)
        return touched

    def replace(self, new: DataFrame) -> list[str]:
        """The slices that new holds become its rows."""
        return self.merge(new, lambda old, rows: rows)

    def append(self, new: DataFrame) -> list[str]:
        """Adds rows without reading or rewriting the old ones."""
        before = self._list()
        staged, touched = self._staged(new)
        if touched or before["schema"] is None:
            schema = new.schema if before["schema"] is None else StructType.fromJson(before["schema"])
            made = self._write(staged.select(*schema.names, _SLICE), before["number"] + 1, touched)
            self._publish(before, schema, before["slices"] | {s: [*before["slices"].get(s, []), f] for s, f in made.items()})
        discard(staged)
        return touched

    def forget_older(self, keep: int = 2) -> int:
        """Removes lists before the last `keep`, and the folders that no remaining list names. Gives the number of folders removed."""
        numbers = self._lists()
        for number in numbers[:-keep]:
            remove(self.spark, f"{self.path}/lists/{number}.json")
        inside_of = lambda folder: folder.rsplit("/versions/", 1)[-1]
        named = {inside_of(f) for n in numbers[-keep:] for own in self._list(n)["slices"].values() for f in own}
        store, at = _path(self.spark, f"{self.path}/versions")
        gone = 0
        for version in store.listStatus(at) if store.exists(at) else []:
            for part in store.listStatus(version.getPath()):
                if part.isDirectory() and inside_of(part.getPath().toString()) not in named:
                    store.delete(part.getPath(), True)
                    gone += 1
        return gone
