"""Quality rules whose thresholds follow the data: one mergeable quantile sketch per language, source and measure.

A sketch is a log-linear histogram of an integer measure: exact below 32, then 16 buckets for each power of two, so a
quantile is off by at most one sixteenth of its value. Two sketches merge by adding their counts, which is a plain
grouped sum: partial sums leave each task, and a language or the whole corpus is the sum of its sources. All of it is
integer arithmetic, so the thresholds are the same on every run and at every partitioning.

A document fails if a measure lies more than FENCE widths above Q3, or below Q1 where a measure has two sides. The width
is Q3 - Q1, or what one occurrence adds to a document of median length where that is more: a measure that is zero in
most documents has no quartile distance, but a document can't have less than one occurrence. Q1, Q3 and the median
length are the group's own, drawn to those of its language, and the language's to those of all documents, as if the
parent gave PARENT documents more: large groups stand by themselves, small ones lean on their parents.

Defined results: a null text has no words and fails the base rules; null language and null source count as the empty
name; repeated rows are judged, and counted, one by one; an empty table gives an empty table; other columns are ignored
by judge() and kept by keep_good().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents' worth of weight that a group's parent has in its quantiles.
PARENT = 200
FENCE = 5
#: For each measure, per thousand of a length: the length, what one occurrence counts, and whether low values fail too.
#: A repeat is two 3-word windows, so 6 words.
MEASURES = {
    "symbols_per_1000_words": ("n_words", 1, False),
    "dup_lines_per_1000_lines": ("n_lines", 1, False),
    "repeats_per_1000_words": ("n_words", 6, False),
    "chars_per_1000_words": ("n_words", 1, True),
}
LENGTHS = ("n_words", "n_lines")
COUNTS = T.StructType([T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) < 1 << 20:
        pairs, base = ids[:-1] * len(index) + ids[1:], len(index)
    else:
        pairs, base = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1], len(index)
    windows = pairs[:-1] * base + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= hit
    return int(covered.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS. Words are runs of anything but the six ASCII white spaces."""
    if not text:
        return (0,) * 6
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, _SPACE))),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@F.pandas_udf(COUNTS)
def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in texts], columns=COUNTS.names, dtype="int64")


_counts = _counts.asNondeterministic()  # so that no filter copies it


def _measures(c: str = "") -> dict[str, Column]:
    per = lambda a, b: F.expr(f"cast(1000 * {c}{a} div greatest({c}{b}, 1) as bigint)")
    return {
        "symbols_per_1000_words": per("n_symbols", "n_words"),
        "dup_lines_per_1000_lines": per("n_dup_lines", "n_lines"),
        "repeats_per_1000_words": per("n_repeat_words", "n_words"),
        "chars_per_1000_words": per("word_chars", "n_words"),
    }


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source (null: empty), the counts, the measures and base_failed of every document."""
    one = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), _counts("text").alias("c"))
    failed = (F.col("c.n_words") < MIN_WORDS) | (100 * F.col("c.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("c.n_words"))
    return one.select("doc_id", "lang", "source", "c.*", *(v.alias(k) for k, v in _measures("c.").items()), failed.alias("base_failed"))


def bucket(value: Column) -> Column:
    """The sketch's bucket of a non-negative long: itself below 32, else 16 buckets for each power of two."""
    power = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(power * 16 + F.call_function("shiftright", value, power)).cast("long")


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    power = (F.floor(b / 16) - 1).cast("int")
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", (b - power * 16).cast("long"), power)).cast("long")


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketches of measures and lengths of all documents with words."""
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), bucket(F.col(k)).alias("bucket")) for k in (*MEASURES, *LENGTHS)))
    rows = counted.where("n_words > 0").select("lang", "source", F.explode(pairs).alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketches: DataFrame, *by: str) -> DataFrame:
    """Q1, Q2, Q3 and the number of documents of each measure in the groups that `by` names.

    Q1 and Q2 are the least values of their buckets, Q3 is the largest of its bucket, so Q3 - Q1 is never less than the
    distance between the quartiles themselves.
    """
    merged = sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    upto = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "docs": F.sum("n").over(w)})
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bucket")))
    low, high = bucket_floor, lambda b: bucket_floor(b + 1) - 1
    return upto.groupBy(*by, "measure").agg(*(f(at(k)).alias(f"q{k}") for k, f in ((1, low), (2, low), (3, high))), F.max("docs").alias("docs"))


def _drawn(own: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """own's quantiles as means of its own and its parent's, weighted by its documents and PARENT."""
    rows = own.join(parent.select(*on, *(F.col(f"q{k}").alias(f"p{k}") for k in (1, 2, 3))), on)
    mean = lambda k: F.expr(f"(docs * q{k} + {PARENT} * p{k}) div (docs + {PARENT})")
    return rows.select(*(c for c in own.columns if c[0] != "q"), *(mean(k).alias(f"q{k}") for k in (1, 2, 3)))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row for each language and source: low_<measure> and high_<measure>."""
    lang = _drawn(_quartiles(sketches, "lang"), _quartiles(sketches), ["measure"])
    rows = _drawn(_quartiles(sketches, "lang", "source"), lang, ["lang", "measure"])
    of = lambda k, q: F.max(F.when(F.col("measure") == k, F.col(q)))
    rows = rows.groupBy("lang", "source").agg(*(of(k, f"q{q}").alias(f"q{q}_{k}") for k in MEASURES for q in (1, 3)), *(of(k, "q2").alias(f"median_{k}") for k in LENGTHS))
    width = lambda k, length, one: f"{FENCE} * greatest(q3_{k} - q1_{k}, {1000 * one} div greatest(median_{length}, 1))"
    limits = [F.expr(f"{x} {sign} {width(k, length, one)}").alias(f"{side}_{k}") for k, (length, one, _) in MEASURES.items() for side, x, sign in (("low", f"q1_{k}", "-"), ("high", f"q3_{k}", "+"))]
    return rows.select("lang", "source", *limits)


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every document, base_failed, kept, and adaptive_failed: the measures beyond their thresholds."""
    counted = materialize(count_documents(docs), "counts")
    limits = materialize(thresholds(sketch(counted)), "limits")  # Spark then knows its size, and broadcasts it only below its own threshold
    rows = counted.join(limits, ["lang", "source"], "left")
    beyond = {k: (F.col(k) > F.col(f"high_{k}")) | ((F.col(k) < F.col(f"low_{k}")) if two else F.lit(False)) for k, (*_, two) in MEASURES.items()}
    failed = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in beyond.items())))
    rows = rows.withColumn("adaptive_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("adaptive_failed") == 0)).alias("kept"), "adaptive_failed")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document the rules keep, every column as it came.

    The rows are written once with their counts beside them; the thresholds come from the counts' columns, and the filter
    is a join of the rows with their group's limits, so no text is counted twice, and rows that share a doc_id are judged
    by their own text.
    """
    group = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    rows = materialize(docs.withColumns({"__group": group, "__c": _counts("text")}), "counted")
    limits = thresholds(sketch(rows.select("__group.*", "__c.*").select("*", *(v.alias(k) for k, v in _measures().items()))))
    limits = limits.select(F.struct("lang", "source").alias("__group"), F.struct(*(F.col(f"{s}_{k}") for k in MEASURES for s in ("low", "high"))).alias("__limits"))
    limits = materialize(limits, "limits")
    rows = rows.where((F.col("__c.n_words") >= MIN_WORDS) & (100 * F.col("__c.n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("__c.n_words")))
    rows = rows.join(limits, "__group", "left")
    for k, v in _measures("__c.").items():
        rows = rows.where(v <= F.col(f"__limits.high_{k}"))
        if MEASURES[k][-1]:
            rows = rows.where(v >= F.col(f"__limits.low_{k}"))
    return rows.select(*docs.columns)
