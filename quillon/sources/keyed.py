"""Tables by key: rows in buckets, of which a change rewrites only those that it touches, and a manifest that says which files count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ranks import checked
from quillon.sources import files

BUCKETS = 64
_BUCKET = "bucket_no"
#: Bytes of rows that a task deals into buckets, where its input is that small.
TASK_BYTES = 32 << 20


class KeyedTable:
    """A table with one row for each key, at ``path``, which driver and executors share.

    The rows of a bucket lie in one folder.  A change writes the buckets that it touches to a new folder and then a new manifest,
    which names the folder of every bucket; whoever reads takes the latest manifest.  A run that is lost on the way leaves files
    that no manifest names: the table is as it was, and the change can be made again.  Changes come one after another; of two that
    start from the same manifest the later one fails.  Old files stay until ``vacuum``.  The number of buckets is set when the table
    is made, so that a bucket's rows are work for one task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._version, self._state = self._latest()

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """The table at ``path``, made without rows if there is none; one that is there is left alone."""
        table = cls(spark, path)
        if table._state is None:
            table._commit({"keys": keys, "buckets": buckets, "schema": schema.json(), "folders": {}})
        return table

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        folders = self._state["folders"]
        return self._rows({int(b): f for b, f in folders.items() if touched is None or int(b) in touched})

    def upsert(self, rows: DataFrame, order: str | None = None, made: list[Column] | None = None) -> list[int]:
        """Put ``rows`` in place of those with their keys; the buckets that were rewritten.

        Of rows with one key the one of highest ``order`` counts, of these (or without an order) the greatest in its other columns,
        so a rerun gives the same.  Rows with a null in a key are keyed by it.  ``made`` are the table's columns as expressions of those of
        ``rows``, which hold the keys: rows are dealt into buckets first and made when they are written, so that wide columns aren't sorted.
        """
        keys = self._state["keys"]
        schema = T.StructType.fromJson(json.loads(self._state["schema"]))
        columns, folder = schema.names, f"data-{uuid.uuid4().hex}"
        rest = [c for c in columns if c not in keys]
        extra = [order] if order and order not in columns else []
        kinds = T.StructType([*schema.fields, *(rows.schema[c] for c in extra)])
        last = F.struct(*([F.col(order).alias("first_of_all")] if order else []), *rest) if rest or order else F.lit(True)
        # written once, to their buckets; what else is asked of them is read there, keys alone where these tell
        self._deal(rows, [*(made or map(F.col, columns)), *extra], folder)
        new = dict.fromkeys(self._filled(folder), folder)
        keyed = files.staged(self._rows(new).select(*keys), "keys")
        many = files.staged(keyed.groupBy(*keys).count().where("count > 1").select(*(F.col(k).alias(f"of_{n}") for n, k in enumerate(keys))), "many")
        if not many.isEmpty():
            again, same = checked(many), [F.col(k).eqNullSafe(F.col(f"of_{n}")) for n, k in enumerate(keys)]
            put, folder = self._rows(new, kinds), f"data-{uuid.uuid4().hex}"
            one = put.join(again, same, "left_semi").groupBy(*keys).agg(F.max(last).alias("row")).select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest))
            self._deal(put.select(*columns).join(again, same, "left_anti").unionByName(one), [F.col(c) for c in columns], folder)
            new = dict.fromkeys(new, folder)
        return self._change(keyed, list(new), folder)

    def delete(self, gone: DataFrame) -> list[int]:
        """Take away the rows with the keys in ``gone``; the buckets that were rewritten."""
        gone = files.staged(gone.select(*self._state["keys"]).distinct(), "gone")
        # at most as many numbers as there are buckets come to the driver
        touched = sorted(r[0] for r in gone.select(self._bucket()).distinct().collect())
        return self._change(gone, [b for b in touched if str(b) in self._state["folders"]], f"data-{uuid.uuid4().hex}")

    def vacuum(self) -> None:
        """Delete the folders and manifests that the latest manifest doesn't need, once no one reads them."""
        needed = {*self._state["folders"].values(), f"manifest-{self._version}.json"}
        for f in self._files.listStatus(self._hadoop.Path(self.path)):
            if f.getPath().getName() not in needed:
                self._files.delete(f.getPath(), True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self._state["keys"]), F.lit(self._state["buckets"])).cast("int").alias(_BUCKET)

    def _rows(self, folders: dict[int, str], schema: T.StructType | None = None) -> DataFrame:
        """The rows of buckets in their folders."""
        schema = schema or T.StructType.fromJson(json.loads(self._state["schema"]))
        paths = [f"{self.path}/{f}/{_BUCKET}={b}" for b, f in folders.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _filled(self, folder: str) -> list[int]:
        """The buckets that a folder holds."""
        where = self._hadoop.Path(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []
        return sorted(int(x[len(_BUCKET) + 1 :]) for x in names if x.startswith(f"{_BUCKET}="))

    def _deal(self, rows: DataFrame, columns: list[Column], folder: str) -> None:
        """Add ``columns`` of ``rows`` to their buckets in ``folder``, from the tasks that have them, which aren't more than there are bytes for."""
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        tasks = max(self.spark.sparkContext.defaultParallelism, min(size // TASK_BYTES, 1 << 20))
        dealt = rows.select("*", self._bucket()).coalesce(tasks).sortWithinPartitions(_BUCKET)
        dealt.select(*columns, _BUCKET).write.mode("append").partitionBy(_BUCKET).parquet(f"{self.path}/{folder}", compression="zstd")

    def _change(self, keyed: DataFrame, touched: list[int], folder: str) -> list[int]:
        """Add to ``folder`` the rows of the touched buckets whose keys aren't among those of ``keyed``, and let it count for them."""
        keys, columns = self._state["keys"], T.StructType.fromJson(json.loads(self._state["schema"])).names
        if touched:
            old = self.read(touched)
            # keys alone tell which rows stay
            names = [f"of_{k}" for k in range(len(keys))]
            named = lambda df: df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)))
            gone = named(keyed).withColumnsRenamed({n: f"{n}_new" for n in names})
            stay = files.staged(named(old).join(gone.hint("merge"), [F.col(n).eqNullSafe(F.col(f"{n}_new")) for n in names], "left_anti"), "stay")
            if not stay.isEmpty():
                self._deal(old.join(checked(stay), [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], "left_semi"), [F.col(c) for c in columns], folder)
        written = set(self._filled(folder))
        folders = {b: f for b, f in self._state["folders"].items() if int(b) not in touched} | {str(b): folder for b in touched if b in written}
        self._commit(self._state | {"folders": folders})
        return touched

    def _latest(self) -> tuple[int, dict | None]:
        where = self._hadoop.Path(self.path)
        names = [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []
        versions = [int(x[len("manifest-") : -len(".json")]) for x in names if x.startswith("manifest-") and x.endswith(".json")]
        if not versions:
            return 0, None
        text = self.spark.read.text(f"{self.path}/manifest-{max(versions)}.json", wholetext=True).first().value
        return max(versions), json.loads(text)

    def _commit(self, state: dict) -> None:
        """Write the next manifest under another name, then rename it, which is one step; fails if there is one by that name."""
        goal, draft = (self._hadoop.Path(f"{self.path}/{name}") for name in (f"manifest-{self._version + 1}.json", f".draft-{uuid.uuid4().hex}"))
        out = self._files.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        if self._files.exists(goal) or not self._files.rename(draft, goal):
            raise RuntimeError(f"{self.path} was changed by another writer")
        self._version, self._state = self._version + 1, state
