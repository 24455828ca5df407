"""An index of known uuids, so that a push doesn't read all of history (JON15, JON16, MRG08, STM07).

Uuids lie in BUCKETS buckets of their hash. For each bucket there is a Bloom filter as rows: a word's number and its 64 bits
as one integer, at most WORDS rows a bucket, whatever it holds. A push looks its uuids up in the filters by a join on
bucket and word, reads only the buckets in which one of them may be, and compares exactly there: a false positive costs the
read of a bucket and never changes a result. A full filter (far more uuids than bits) only means that buckets are
read in vain; raise BUCKETS before it comes to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import stored
from ..store import MetadataStore
from .buckets import Buckets, bucket_of
from .catalog import exploded_uuids

BUCKETS, WORDS, HASHES = 256, 1024, 4


def _bits(uuids: DataFrame) -> DataFrame:
    """uuid, bucket, and one row for each hash: the word and the bit in it."""
    places = F.array(*(F.pmod(F.xxhash64("uuid", F.lit(i)), F.lit(WORDS * 64)) for i in range(HASHES)))
    rows = uuids.select("uuid", bucket_of("uuid", BUCKETS).alias("bucket"), F.explode(places).alias("place"))
    return rows.select("uuid", "bucket", F.floor(F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))


def _split(incoming: DataFrame) -> DataFrame:
    return incoming.select("id", F.explode(F.split("uuids", ",")).alias("uuid"))


class KnownUuids(Buckets):
    """The uuids of a store's executions, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, {"uuids": "uuid string, bucket int", "filters": "word int, bits long, bucket int"})

    def add(self, uuids: DataFrame) -> None:
        """Put uuids (uuid) in, nulls left out; known ones change nothing. Only their buckets are read and written."""
        old = self.manifest()
        new = stored(uuids.select("uuid").where("uuid is not null").distinct().withColumn("bucket", bucket_of("uuid", BUCKETS)))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        rows = self.read(old, "uuids", touched).unionByName(new).distinct()
        bits = self.read(old, "filters", touched).unionByName(_bits(new).select("word", F.col("bit").alias("bits"), "bucket"))
        self.commit(old, {"uuids": (touched, rows), "filters": (touched, bits.groupBy("word", "bucket").agg(F.bit_or("bits").alias("bits")).select("word", "bits", "bucket"))})

    def add_store(self, store: MetadataStore) -> None:
        self.add(exploded_uuids(store))

    def _perhaps(self, manifest: dict, uuids: DataFrame) -> DataFrame:
        """uuid and bucket of those that their bucket's filter doesn't rule out."""
        filters = self.read(manifest, "filters", list(range(BUCKETS)))
        hits = _bits(uuids).join(filters, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return hits.groupBy("uuid", "bucket").agg(F.count("*").alias("n")).where(F.col("n") == HASHES).select("uuid", "bucket")

    def known(self, uuids: DataFrame) -> tuple[DataFrame, list[int]]:
        """The uuids (uuid) that are known, each once, and the buckets that were read for that."""
        manifest = self.manifest()
        perhaps = stored(self._perhaps(manifest, uuids.select("uuid").where("uuid is not null").distinct()))
        touched = [r.bucket for r in perhaps.select("bucket").distinct().collect()]  # BUCKETS at most
        return self.read(manifest, "uuids", touched).join(perhaps.select("uuid"), "uuid", "left_semi").select("uuid"), touched

    def new_executions(self, incoming: DataFrame) -> DataFrame:
        """JON15, MRG08: as merge.new_executions(), from the buckets that the incoming uuids may lie in."""
        parts = _split(incoming)
        unknown = parts.join(self.known(parts)[0], "uuid", "left_anti").select("id").distinct()
        named: Column = F.coalesce(F.col("name"), F.lit("")) != ""
        return incoming.join(unknown.union(incoming.where(named).select("id")).distinct(), "id", "left_semi")
