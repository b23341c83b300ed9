"""Tables that change in place: bucketed, in generations, with commits that can be repeated.

A table's rows lie in buckets by a hash of the columns ``by`` (a unit: all rows that are equal there stay together). A commit
writes whole new units of the buckets it touches into folders of its own, and then one small manifest that names, for each
bucket, the folders that count. Until the manifest is renamed into place nothing has changed, so a commit that fails half way
is simply run again and overwrites its own leftovers; a commit whose name the newest manifest bears is not run twice. Buckets
that a commit does not touch keep their files.

An upsert adds a generation to its buckets (of a unit the newest generation counts); a bucket with ``most`` generations is
compacted by the commit that would add one more, so what is kept follows the units, not their versions. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


@dataclass(frozen=True)
class Spec:
    """Columns of a table (a DDL text), those that make a unit, how many buckets it has, and (if not all of ``by``) the columns
    that settle the bucket."""

    columns: str
    by: tuple[str, ...]
    buckets: int = 64
    dealt_by: tuple[str, ...] = ()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.dealt_by or self.by)), F.lit(self.buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Spec], most: int = 8):
        self.spark, self.path, self.tables, self.most = spark, path.rstrip("/"), tables, most

    # --- manifests -----------------------------------------------------------------------------------------------------

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, at: str) -> list[str]:
        p = self._path(at)
        return sorted(s.getPath().getName() for s in self._files.listStatus(p)) if self._files.exists(p) else []

    def manifest(self) -> dict:
        """number, commit (its name) and tables: name -> bucket -> generations, oldest first."""
        known = [n for n in self._names("_commits") if n.endswith(".json")]
        if not known:
            return {"number": 0, "commit": None, "tables": {}}
        stream = self._files.open(self._path(f"_commits/{known[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, told: dict) -> None:
        draft, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{told['number']:010d}.json")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"commit {told['number']} exists already: another writer was faster")

    # --- rows ----------------------------------------------------------------------------------------------------------

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """Current rows, of all buckets or of some."""
        return self._rows(name, self.manifest(), only)

    def _rows(self, name: str, told: dict, only: list[int] | None) -> DataFrame:
        spec = self.tables[name]
        held = {int(b): g for b, g in told["tables"].get(name, {}).items() if g and (only is None or int(b) in set(only))}
        schema = f"{spec.columns}, _generation long"
        if not held:
            return self.spark.createDataFrame([], schema).drop("_generation")
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{g:010d}/bucket={b}" for b, gs in held.items() for g in gs))
        if any(len(g) > 1 for g in held.values()):
            newest = F.max("_generation").over(W.partitionBy(*spec.by))
            rows = rows.withColumn("_newest", newest).where("_generation = _newest").drop("_newest")
        return rows.drop("_generation")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """Buckets of the units in ``rows``: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.tables[name].bucket().alias("b")).distinct().collect())

    def _write(self, name: str, rows: DataFrame, number: int, buckets: list[int]) -> set[int]:
        """The buckets that got rows."""
        spec, at = self.tables[name], f"{name}/{number:010d}"
        columns = [f.name for f in self.spark.createDataFrame([], spec.columns).schema]
        rows = rows.select(*columns, F.lit(number).cast("long").alias("_generation"), spec.bucket().alias("bucket")).where(F.col("bucket").isin(buckets))
        rows.repartition(max(1, len(buckets)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{at}")
        return {int(n.split("=")[1]) for n in self._names(at) if n.startswith("bucket=")}

    def _commit(self, commit: str, steps: Callable[[dict, int], dict[str, list[tuple[DataFrame, list[int], bool]]]]) -> bool:
        told = self.manifest()
        if told["commit"] == commit:
            return False
        number = told["number"] + 1
        tables = {t: dict(b) for t, b in told["tables"].items()}
        for name, parts in steps(told, number).items():
            if not parts:
                continue
            rows, buckets = parts[0][0], [b for p in parts for b in p[1]]
            for more in parts[1:]:
                rows = rows.unionByName(more[0])
            written = self._write(name, rows, number, buckets)
            held = tables.setdefault(name, {})
            for _, some, whole in parts:
                for b in some:
                    old = [] if whole else held.get(str(b), [])
                    held[str(b)] = [*old, number] if b in written else old
        self._publish({"number": number, "commit": commit, "tables": tables})
        return True

    def upsert(self, commit: str, changes: dict[str, DataFrame]) -> bool:
        """Whole new units, by table. False if this commit is in already."""

        def steps(told: dict, number: int) -> dict:
            out = {}
            for name, rows in changes.items():
                by, hit = list(self.tables[name].by), self.touched(name, rows)
                full = [b for b in hit if len(told["tables"].get(name, {}).get(str(b), [])) >= self.most]
                light = [b for b in hit if b not in set(full)]
                bucket = self.tables[name].bucket()
                parts = [(rows.where(bucket.isin(light)), light, False)] if light else []
                if full:
                    old = self._rows(name, told, full).join(rows.select(*by).distinct(), by, "left_anti")
                    parts.append((old.unionByName(rows.where(bucket.isin(full)).select(*old.columns)), full, True))
                out[name] = [(p.select(*parts[0][0].columns), b, w) for p, b, w in parts]
            return out

        return self._commit(commit, steps)

    def change(self, commit: str, hits: dict[str, DataFrame], operation: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> bool:
        """Run a change of tables on the buckets that it touches. hits: for each table rows (at least the columns ``by``) of the
        units that may change; operation: gets the current rows of those buckets by table, and returns what they are to be."""

        def steps(told: dict, number: int) -> dict:
            buckets = {name: self.touched(name, rows) for name, rows in hits.items()}
            new = operation({name: self._rows(name, told, b) for name, b in buckets.items()})
            return {name: [(new[name], b, True)] if b else [] for name, b in buckets.items()}

        return self._commit(commit, steps)

    def vacuum(self) -> int:
        """Delete what no longer counts: folders of generations that the newest manifest does not name, older manifests and drafts.
        Nothing may read older states any more. Returns how many folders went."""
        told, gone = self.manifest(), 0
        for name in self.tables:
            used = {f"{g:010d}" for gs in told["tables"].get(name, {}).values() for g in gs}
            for folder in self._names(name):
                if folder not in used:
                    gone += bool(self._files.delete(self._path(f"{name}/{folder}"), True))
                    continue
                number = int(folder)
                for b in self._names(f"{name}/{folder}"):
                    if b.startswith("bucket=") and number not in told["tables"][name].get(b.split("=")[1], []):
                        gone += bool(self._files.delete(self._path(f"{name}/{folder}/{b}"), True))
        for n in self._names("_commits"):
            if n != f"{told['number']:010d}.json":
                self._files.delete(self._path(f"_commits/{n}"), False)
        return gone
