"""A search index for browsing (FLT28, FLT29, STR03): n-gram postings in hash buckets, kept up by changed entities.

An entity's text in lower case is cut into its distinct grams of GRAM characters. Ids lie in blocks of BLOCK neighbours, and
a posting is a gram and those of a block that have it: their places in the block, or a bit for each place where that is
shorter. So a gram that all have costs a bit an entity, and no row is made for each gram of each text. A posting is stored
in the bucket of its gram's hash; beside the postings lie the entities' texts, by a hash of their block, so that a change
knows what was there, and what is found can be verified. A search takes the grams of the pattern's literal parts (% and _
are wildcards), reads the buckets of the rarest of them only, intersects, and verifies with ilike. A pattern without a part
of GRAM characters has no candidates to offer, and all texts are scanned.

Both are kept by buckets.py: an update rewrites the touched buckets, and of two writers at once one fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import stored
from ..functions.values import properties_json
from ..store import MetadataStore
from .browse import created_time, execution_text
from .buckets import Buckets, bucket_of

GRAM, BUCKETS, RAREST = 3, 64, 4
BITS = 13
BLOCK = 1 << BITS
#: Tables of grams up to this size are addressed directly, larger ones sorted.
DIRECT = 1 << 27


def _places(at: bytes, n: int) -> np.ndarray:
    """Which places of a block a posting has, as booleans."""
    if len(at) == BLOCK // 8:
        return np.unpackbits(np.frombuffer(at, "u1")).astype(bool)
    out = np.zeros(BLOCK, bool)
    out[np.frombuffer(at, "<u2")] = True
    return out


def _postings(places: np.ndarray, texts: list[str]) -> dict[str, tuple[int, bytes]]:
    """The postings (n, at) of one block's texts in lower case, by gram."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    of = np.repeat(places.astype("i8"), [len(t) for t in texts])
    if len(chars) < GRAM:
        return {}
    known = np.flatnonzero(np.bincount(chars))  # the block's alphabet
    nth = np.zeros(known[-1] + 1, "i8")
    nth[known] = np.arange(len(known))
    letters, size = nth[chars], len(known)
    inside = of[: 1 - GRAM] == of[GRAM - 1 :]
    codes, of = ((letters[:-2] * size + letters[1:-1]) * size + letters[2:])[inside], of[: 1 - GRAM][inside]
    if not len(codes):
        return {}
    if size**GRAM <= DIRECT >> 3:
        distinct = np.flatnonzero(np.bincount(codes, minlength=size**GRAM))
        nth = np.zeros(size**GRAM, "i8")
        nth[distinct] = np.arange(len(distinct))
        codes = nth[codes]
    else:
        distinct, codes = np.unique(codes, return_inverse=True)
    pairs = codes * BLOCK + of
    if len(distinct) * BLOCK <= DIRECT:
        there = np.zeros(len(distinct) * BLOCK, bool)
        there[pairs] = True
        pairs = np.flatnonzero(there)
    else:
        pairs = np.unique(pairs)
    counts = np.bincount(pairs >> BITS, minlength=len(distinct))
    short = (pairs & (BLOCK - 1)).astype("<u2")
    parts = known[np.stack([distinct // size // size, distinct // size % size, distinct % size], 1)].astype("<u4")
    names = parts.tobytes().decode("utf-32-le")
    out, end = {}, 0
    for k, n in enumerate(counts.tolist()):
        mine, end = short[end : end + n], end + n
        if 2 * n < BLOCK // 8:
            at = mine.tobytes()
        else:
            bits = np.zeros(BLOCK, bool)
            bits[mine] = True
            at = np.packbits(bits).tobytes()
        out[names[GRAM * k : GRAM * k + GRAM]] = n, at
    return out


_POSTINGS = "gram string, block long, n int, at binary"


def _moves(rows: pa.Table) -> pa.Table:
    """The postings of one block (block, place, text, now) that are other now than before; n is 0 for those that are gone."""
    block, place = rows["block"][0].as_py(), rows["place"].to_numpy()
    now, texts = np.asarray(rows["now"].to_pylist(), bool), rows["text"].to_pylist()
    was, new = (_postings(place[now == side], [t for t, x in zip(texts, now, strict=True) if x == side]) for side in (False, True))
    moved = [(g, *p) for g, p in new.items() if was.get(g) != p] + [(g, 0, b"") for g in was if g not in new]
    grams, n, at = zip(*moved, strict=True) if moved else ((), (), ())
    return pa.table({"gram": pa.array(grams, pa.string()), "block": pa.array([block] * len(grams), pa.int64()), "n": pa.array(n, pa.int32()), "at": pa.array(at, pa.binary())})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids that all postings of a block have; rows: block, postings (n, at)."""
    for batch in batches:
        for block, postings in zip(batch["block"].to_pylist(), batch["postings"].to_pylist(), strict=True):
            both = np.logical_and.reduce([_places(p["at"], p["n"]) for p in postings])
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(both) + (block << BITS), pa.int64())], names=["id"])


def pattern_grams(spark: SparkSession, search: str) -> list[str]:
    """The grams that every match has; lower case as Spark has it."""
    low = spark.range(1).select(F.lower(F.lit(search))).first()[0]
    parts = re.split(r"[%_]|\\.", low)  # an escaped character ends a part too
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def execution_texts(store: MetadataStore, executions: DataFrame | None = None) -> DataFrame:
    """id and text of executions (execution_id), or of all: what a search for executions looks at."""
    ids, props = store.execution.select(F.col("id").alias("execution_id")), store.executionproperty
    if executions is not None:
        ids = executions.select("execution_id").distinct()
        props = props.join(ids.hint("merge"), "execution_id", "left_semi")
    about = props.groupBy("execution_id").agg(properties_json().alias("execution_properties"), created_time().alias("create_time"))
    return ids.join(about.hint("merge"), "execution_id", "left").select(F.col("execution_id").alias("id"), F.concat_ws("", *execution_text()).alias("text"))


class Index(Buckets):
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, {"postings": f"{_POSTINGS}, bucket int", "entities": "id long, text string, bucket int"})

    def update(self, texts: DataFrame) -> None:
        """Put the entities (id, text) in, in place of what they were before. A null text takes the entity out; of rows with one id the longest text counts."""
        old, block = self.manifest(), F.shiftright("id", BITS).alias("block")
        one = texts.where("id is not null").groupBy("id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("t"))
        new = one.select("id", F.col("t.text").alias("text"), bucket_of([block], BUCKETS).alias("bucket"))
        homes, before, after = list(range(BUCKETS)), None, new
        if old["entities"]:  # else everything is new, and nothing has to be looked up
            new = stored(new)
            homes = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            before = self.read(old, "entities", homes)
            after = before.join(new.select("id"), "id", "left_anti").unionByName(new)
        written = self.write(old, {"entities": (homes, after.where("text is not null"))})
        side = lambda df, now: df.select(block, F.col("id").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("place"), F.lower("text").alias("text"), F.lit(now).alias("now"))
        rows = side(self.read(old | {"entities": written["entities"][1]}, "entities", homes), True)
        if before is not None:
            rows = rows.unionByName(side(before, False)).join(new.select(block).distinct(), "block", "left_semi")
        moves = rows.groupBy("block").applyInArrow(_moves, _POSTINGS).withColumn("bucket", bucket_of("gram", BUCKETS))
        touched, postings = list(range(BUCKETS)), moves
        if before is not None:
            moves = stored(moves)
            touched = [r.bucket for r in moves.select("bucket").distinct().collect()]  # BUCKETS at most
            postings = self.read(old, "postings", touched).join(moves.select("gram", "block"), ["gram", "block"], "left_anti").unionByName(moves)
        self.publish(old, written | self.write(old, {"postings": (touched, postings.where("n > 0"))}))

    def candidates(self, search: str) -> DataFrame | None:
        """id of the entities that have all of the rarest grams of a pattern; None if it has no gram, so that any may match."""
        wanted = pattern_grams(self.spark, search)
        if not wanted:
            return None
        homes = [r.b for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(bucket_of("gram", BUCKETS).alias("b")).distinct().collect()]
        rows = self.read(self.manifest(), "postings", homes).where(F.col("gram").isin(wanted))
        counts = {r.gram: r.n for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each gram of the pattern
        if len(counts) < len(wanted):
            return self.spark.createDataFrame([], "id long")
        rare = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
        blocks = rows.where(F.col("gram").isin(rare)).groupBy("block").agg(F.collect_list(F.struct("n", "at")).alias("postings"))
        return blocks.where(F.size("postings") == len(rare)).mapInArrow(_shared, "id long")

    def found(self, search: str, among: DataFrame | None = None) -> DataFrame:
        """id and text of the entities whose text has the pattern, verified; among: ids (id) that it can find."""
        rows, ids = self.read(self.manifest(), "entities", list(range(BUCKETS))), self.candidates(search)
        if among is not None:
            ids = among if ids is None else ids.join(among, "id", "left_semi")
        rows = rows if ids is None else rows.join(stored(ids.select("id")), "id", "left_semi")
        return rows.where(F.col("text").ilike(f"%{search}%")).select("id", "text")
