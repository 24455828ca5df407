"""SimHash near-duplicates by multi-index hashing.

A fingerprint is 64 majority votes over the XXH64 hashes of a text's 3-word shingles. Two documents are linked if their
fingerprints differ in at most 3 bits, and a component is all that links reach.

Every step works on distinct fingerprints, so copies cost one row. Each fingerprint is cut into two 32-bit segments. Of
3 differing bits at most one lies in one of the two, so every linked pair meets when the Hamming ball of radius 1 about
each segment is looked up in the table of that segment's values; only flips from 0 to 1 are enumerated, since the other
side makes the opposite flip. Whole distances are verified on what the table returns.

Families of near copies share segments, so their table entries could grow long and give pairs by the square. A first pass
ties each fingerprint to the smallest one that shares a segment, or a segment and half of the other (verified, one row
each), and contracts the components that arise. In the second pass an entry whose members all belong to the prober's
component is dropped before any pair is made: it can't join anything new. An entry of more than CROWD members that is
still open isn't expanded but indexed again by what its members don't have in common: of 3 differing bits at most one
lies in one half of that rest, so balls of radius 1 about its two halves meet every linked pair. That is done down to
pieces of 8 bits, where 256 values are all there can be. So a prober meets at most so many members of an entry, however
many share a segment, and no link between components is lost.

No join broadcasts: a table entry's file is small, but the balls about it aren't, and the driver would have to hold them.

Components come from alternating large and small stars: min-aggregations and joins, never a collected edge list.

Defined results: a text without words (null, empty, white space only) has fingerprint zero and links like any other; one
with fewer than three words is one shingle; a null doc_id takes part, but never names a component (null if all are);
repeated rows come back once each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

WORDS = 3
DISTANCE = 3
SEED = 42
#: Members of a table entry beyond which it is indexed again.
CROWD = 64

#: The bits of each byte value, least first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one whole text; ASCII letters in lower case, words between the six ASCII white spaces."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, n = b" ".join(words), len(words) - WORDS + 1
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[WORDS - 1 :].tolist(), strict=True)]
    columns = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int((2 * votes > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


_fingerprints = _fingerprints.asNondeterministic()  # so that no filter copies it


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    return docs.select("doc_id", _fingerprints("text").alias("fp"))


def _segments(fp: str) -> list[Column]:
    """High and low half of a fingerprint, as non-negative longs."""
    return [F.shiftrightunsigned(fp, 32), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))]


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that is shuffled at any size: both sides grow with the corpus, and their files don't tell how many rows explode() makes of them."""
    return left.join(right.hint("merge"), on, how)


def pivot_links(fps: DataFrame) -> DataFrame:
    """(u, v): each fingerprint with the smallest that shares a segment, or 48 bits, where they are near enough."""
    high, low = _segments("fp")
    parts = [(high, None), (low, None)] + [(a, half(b)) for a, b in ((high, low), (low, high)) for half in (lambda x: F.shiftrightunsigned(x, 16), lambda x: x.bitwiseAND(F.lit(0xFFFF)))]
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), a.alias("a"), (F.lit(0).cast("long") if b is None else b).alias("b")) for k, (a, b) in enumerate(parts)))
    rows = fps.select("fp", F.explode(keys).alias("key"))
    pivots = rows.groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last")).where("pivot < last").drop("last")
    near = _join(rows, pivots, "key").where((F.col("fp") != F.col("pivot")) & (_apart("fp", "pivot") <= DISTANCE))
    return near.select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct()


def _ball(value: str, bits: int) -> str:
    """SQL of the values at most one bit away."""
    return f"concat(array({value}), transform(sequence(0, {bits - 1}), b -> {value} ^ shiftleft(1L, b)))"


def _halves(rest: str, bits: int) -> str:
    """SQL of an array of structs: which half of the lowest `bits` bits of rest, its value, and the other half."""
    low = f"({rest} & {(1 << bits // 2) - 1}L)"
    high = f"(shiftrightunsigned({rest}, {bits // 2}) & {(1 << bits // 2) - 1}L)"
    return f"array(named_struct('half', 0, 'value', {high}, 'rest', {low}), named_struct('half', 1, 'value', {low}, 'rest', {high}))"


def _compare(table: DataFrame, probes: DataFrame, bits: int) -> DataFrame:
    """(fp, comp, fp2, comp2) to verify: probers (key, rest, fp, comp) beside members of the same key; rest: the `bits` bits that the key leaves open."""
    sizes = table.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("members"))
    open_probes = _join(probes, sizes, "key").where((F.col("least") != F.col("comp")) | (F.col("most") != F.col("comp"))).drop("least", "most")
    pairs = lambda p: _join(p.select("key", "fp", "comp"), table.select("key", F.col("fp").alias("fp2"), F.col("comp").alias("comp2")), "key").where("comp != comp2").drop("key")
    crowded = sizes.where(F.col("members") > CROWD).select("key")
    if bits <= 8 or crowded.isEmpty():
        return pairs(open_probes)
    open_probes = materialize(open_probes, "probes")
    half = bits // 2
    deeper = lambda df, values: df.select("fp", "comp", "key", F.explode(F.expr(_halves("rest", bits))).alias("h")).select(
        "fp", "comp", F.col("h.rest").alias("rest"), F.explode(F.expr(values)).alias("value"), F.col("key").alias("above"), F.col("h.half").alias("half")
    ).select("fp", "comp", "rest", F.struct("above", "half", "value").alias("key"))
    members = materialize(deeper(_join(table, crowded, "key", "left_semi"), "array(h.value)"), "members")
    probers = deeper(open_probes.where(F.col("members") > CROWD), _ball("h.value", half))
    return pairs(open_probes.where(F.col("members") <= CROWD)).unionByName(_compare(members, probers, half))


def compared(fps: DataFrame) -> DataFrame:
    """(fp, comp, fp2, comp2): the pairs of fingerprints whose whole distance is verified; every linked pair of two components is among them."""
    other = F.reverse(F.array(*_segments("fp")))
    index = F.array(*(F.struct(F.lit(k).alias("seg"), s.alias("value"), F.get(other, F.lit(k)).alias("rest")) for k, s in enumerate(_segments("fp"))))
    table = fps.select("fp", "comp", F.explode(index).alias("at"))
    flips = F.expr("concat(array(at.value), transform(filter(sequence(0, 31), b -> (at.value & shiftleft(1L, b)) = 0), b -> at.value | shiftleft(1L, b)))")
    key = lambda value: F.struct(F.col("at.seg").alias("seg"), F.col(value).alias("value")).alias("key")
    probes = table.select("fp", "comp", "at", F.explode(flips).alias("value")).select("fp", "comp", F.col("at.rest").alias("rest"), key("value"))
    return _compare(table.select("fp", "comp", F.col("at.rest").alias("rest"), key("at.value")), probes, 32)


def ball_links(fps: DataFrame) -> DataFrame:
    """(u, v): components of all linked pairs whose fingerprints (fp) belong to different components (comp)."""
    met = compared(fps).where(_apart("fp", "fp2") <= DISTANCE)
    return met.select(F.greatest("comp", "comp2").alias("u"), F.least("comp", "comp2").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links with the smallest node that it reaches. Alternates large and small stars until the links stand still."""
    links, before = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links"), None
    while True:
        both = links.union(links.select("v", "u"))
        roots = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
        large = _join(both, roots, "u").where("v > u").select(F.col("v").alias("u"), F.col("root").alias("v"))
        large, done = materialize(large.union(roots.where("u != root").select("u", F.col("root").alias("v"))).distinct(), "links"), links
        roots = large.groupBy("u").agg(F.min("v").alias("root"))
        small = _join(large, roots, "u").where("v != root").select(F.col("v").alias("u"), F.col("root").alias("v"))
        links = materialize(small.union(roots.select("u", F.col("root").alias("v"))).distinct(), "links")
        discard(done)
        discard(large)
        state = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _roots(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """nodes with column `name` led to the root of its component; a node without links is its own."""
    found = components(links)
    return _join(nodes, found.withColumnRenamed("node", name), name, "left").withColumn(name, F.coalesce("root", name)).drop("root")


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, comp) for a table of distinct fingerprints; comp is a fingerprint of the component."""
    fps = materialize(_roots(fps.select("fp", F.col("fp").alias("comp")), pivot_links(fps), "comp"), "fps")
    return _roots(fps, ball_links(fps), "comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, for every row."""
    rows = materialize(fingerprints(docs), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    comps = materialize(_join(fingerprint_components(firsts.select("fp")), firsts, "fp"), "comps")
    names = _join(comps, comps.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("fp", "component_id")
    return _join(rows, names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, every column as it came: the smallest doc_id (null last), ties by the text's hash."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    rows = materialize(docs.select(rank.alias("rank"), _fingerprints("text").alias("fp")), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("rank").alias("rank")), "firsts")
    kept = _join(fingerprint_components(firsts.select("fp")), firsts, "fp").groupBy("comp").agg(F.min("rank").alias("__rank")).select("__rank")
    return _join(docs.withColumn("__rank", rank), materialize(kept, "kept"), "__rank", "left_semi").dropDuplicates(["__rank"]).drop("__rank")
