"""A table of the newest row of each key that several writers keep at once (STM03, STM06).

The table lies in BUCKETS hash buckets of its key and is committed by manifests (operators/buckets.py). A batch reads and
rewrites the buckets of its keys only. A writer that loses a version to another looks at what changed since it read: where
none of its own buckets did, its files are good as they are and only the manifest is made again; else the batch is merged
once more with the newer rows. So no row is lost, whoever wins, and writers of different keys hardly cost each other anything.

The manifest also names the last batch of each writer: a batch that is repeated after a failure, whether it was committed
or not, is in the table once. Versions beyond KEEP are deleted as new ones come, so that what is listed stays bounded.

Defined results: of rows with equal keys the one largest in `order` stays, a null being the smallest; of ties the one that
came later, and within a batch the largest row. Null keys are keys like any other. An empty batch commits nothing.
"""

from __future__ import annotations

import random
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..checkpoint import stored
from ..operators import merge
from ..operators.buckets import Buckets, Conflict, bucket_of

#: Parts of a table, versions that readers may still be at, and attempts of a batch before its stream fails.
BUCKETS, KEEP, ATTEMPTS = 64, 10, 40


class Upserts(Buckets):
    """A table with these columns (a schema, or its DDL; no maps, which have no order) and keys, in a folder that all executors share."""

    part = "provlake_bucket"

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], order: str) -> None:
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.keys, self.order = keys, order
        super().__init__(spark, path, {"rows": StructType(list(self.schema)).add(self.part, IntegerType())})

    def rows(self) -> DataFrame:
        """The table as the newest commit has it."""
        return self.read(self.manifest(), "rows", list(range(BUCKETS))).select(*self.schema.names)

    def upsert(self, batch: DataFrame, writer: str | None = None, epoch: int = 0) -> dict:
        """Merge a batch into the table; the manifest that holds it. writer, epoch: who sends it, and its number, which never falls."""
        new = stored(self._newest(batch.select(*self.schema.names).withColumn(self.part, bucket_of(self.keys, BUCKETS))))
        touched = sorted(r[0] for r in new.select(self.part).distinct().collect())  # BUCKETS at most
        base = written = None
        for attempt in range(ATTEMPTS):
            old = self.manifest()
            done = old.get("writers", {})
            if not touched or writer is not None and done.get(writer, -1) >= epoch:
                return old
            if base is None or old["version"] - base["version"] >= KEEP // 2 or any(old["rows"].get(str(b)) != base["rows"].get(str(b)) for b in touched):
                merged = merge.upsert(self.read(old, "rows", touched), new, [self.part, *self.keys], self.order)
                base, written = old, self.write(old, {"rows": (touched, merged.select(*self.schema.names, self.part))})
            try:
                now = self.publish(old, written, {"writers": done | {writer: epoch}} if writer is not None else None)
            except Conflict:
                time.sleep(random.uniform(0, 0.05 * min(attempt + 1, 20)))
                continue
            if now["version"] % KEEP == 0:
                self.vacuum(KEEP)
            return now
        raise Conflict(f"{self.path}: other writers came first {ATTEMPTS} times")

    def _newest(self, batch: DataFrame) -> DataFrame:
        """One row for each key of a batch."""
        keys = [self.part, *self.keys]
        rest = [c for c in batch.columns if c not in keys]
        best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(self.order, *rest)).alias("__v"))
        return best.select(*(c if c in keys else F.col(f"__v.{c}").alias(c) for c in batch.columns))
