"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Each feature is binned at quantiles of the training sample. Boosting goes round the features, and fits a shallow tree
(at most four leaves) to the log-loss of one feature at a time; since a tree over one binned feature is a step function,
adding it to that feature's lookup table is all there is to keep. Then the pairs of features whose joint residuals
promise most get tables of their own, from trees that split each of the two once. A score is the logistic of a sum of
table entries: bins are found and entries added column by column, for whole batches.

The fit takes at most MAX_ROWS labelled rows, drawn by a hash of doc_id and features, whatever the size of the corpus:
of many labels a share is taken first, so that about half as many rows again reach the driver in all. Features of all documents are computed once and kept as a table of numbers; texts aren't shuffled.

Defined results: null and empty texts have zero features and get the score that the tables give these; a null doc_id has
no label and isn't held out; labels other than 0 and 1 are ignored; several labels of one document are several rows;
without labels of both classes the score is their smoothed share (0.5 without any); repeated rows come back once each;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .quality_rules import repeat_words

#: Labelled rows that the fit takes at most.
MAX_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 4
LEAST_HESSIAN = 2.0
THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_chars", "symbols", "dup_lines", "repeats", "distinct_words", "top_word", "upper", "digits",
    "marks", "shouts", "bars", "beyond_ascii", "line_words", "longest_run",
)
_SCHEMA = T.StructType([T.StructField(x, T.DoubleType()) for x in FEATURES])
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"


def features_of(text: str | None) -> tuple[float, ...]:
    """The features of one whole text; shares are of words or of bytes."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return (0.0,) * len(FEATURES)
    n, size = len(words), len(data)
    count = lambda chars: size - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    run = longest = 0
    last = None
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        run = run + 1 if w == last else 1
        longest = run if run > longest else longest
        last = w
    return (
        float(np.log1p(n)), (size - count(_SPACE)) / n, count(_SYMBOLS) / n, 1 - len(set(lines)) / len(lines), repeat_words(words) / n,
        len(seen) / n, max(seen.values()) / n, count(_UPPER) / size, count(_DIGITS) / size,
        count(_MARKS) / n, data.count(b"!") / n, data.count(b"|") / n, (size - len(text)) / size, n / len(lines), longest / n,
    )


@F.pandas_udf(_SCHEMA)
def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features_of(t) for t in texts], columns=FEATURES, dtype="float64")


_features = _features.asNondeterministic()  # so that no filter copies it


@dataclass
class Model:
    """Lookup tables over bins. edges: of each feature; tables: an entry for each bin; pairs: (i, j, coarse edges of both, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(columns[0]) if columns else 0, self.intercept)
        for x, edges, table in zip(columns, self.edges, self.tables, strict=True):
            total += table[np.searchsorted(edges, x, "right")]
        for i, j, left, right, table in self.pairs:
            total += table[np.searchsorted(left, columns[i], "right"), np.searchsorted(right, columns[j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Up to bins - 1 edges between distinct values, at quantiles of the values and of the distinct values."""
    distinct = np.unique(x)
    if len(distinct) < 2:
        return np.empty(0)
    middles = (distinct[1:] + distinct[:-1]) / 2
    wanted = np.concatenate([np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(distinct, np.linspace(0, 1, bins // 2 + 1)[1:-1])])
    return np.unique(middles[np.minimum(np.searchsorted(middles, wanted), len(middles) - 1)])


def _steps(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A tree's step function over bins: greedy splits by the gain of Newton steps, from sums of gradients and hessians."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)

    def best(a: int, b: int) -> tuple[float, int, int, int]:
        at = np.arange(a + 1, b)
        at = at[(ch[at] - ch[a] >= LEAST_HESSIAN) & (ch[b] - ch[at] >= LEAST_HESSIAN)]
        if not len(at):
            return 0.0, a, b, -1
        gains = worth(a, at) + worth(at, b) - worth(a, b)
        k = int(np.argmax(gains))
        return float(gains[k]), a, b, int(at[k])

    parts = [best(0, len(g))]
    while len(parts) < leaves and (top := max(parts))[0] > 1e-6:
        parts.remove(top)
        parts += [best(top[1], top[3]), best(top[3], top[2])]
    out = np.zeros(len(g))
    for _, a, b, _ in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _crosses(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that splits a pair's grid once each way: its gain and step function."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    at = np.s_[1:-1, 1:-1]
    quarters = lambda c: (c[at], c[1:-1, -1:] - c[at], c[-1:, 1:-1] - c[at], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[at])
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    qg, qh = quarters(cg), quarters(ch)
    gain = sum(a**2 / (b + 1) for a, b in zip(qg, qh, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (rows, cols), a, b in zip(((np.s_[: i + 1], np.s_[: j + 1]), (np.s_[: i + 1], np.s_[j + 1 :]), (np.s_[i + 1 :], np.s_[: j + 1]), (np.s_[i + 1 :], np.s_[j + 1 :])), qg, qh, strict=True):
        out[rows, cols] = a[i, j] / (b[i, j] + 1)
    return float(gain[i, j]), out


def fit(columns: list[np.ndarray], y: np.ndarray) -> Model:
    """Learn the tables from the training sample's feature columns and its labels (0 or 1)."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    model = Model(float(np.log(share / (1 - share))), [_edges(x, BINS) for x in columns], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x, "right") for e, x in zip(model.edges, columns, strict=True)]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables, strict=True):
            if len(table) > 1:
                g, h = slopes()
                step = RATE * _steps(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
                table += step
                total += step[b]
    coarse = [_edges(x, PAIR_BINS) for x in columns]
    small = [np.searchsorted(e, x, "right") for e, x in zip(coarse, columns, strict=True)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell, (g, h) = small[i] * shape[1] + small[j], slopes()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_crosses(*grids(i, j)[1:])[0], i, j) for i in range(len(columns)) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in model.pairs:
            cell, g, h = grids(i, j)
            step = RATE * _crosses(g, h)[1]
            table += step
            total += step.ravel()[cell]
    return model


def held_out(doc_id: str) -> Column:
    """Whether crc32 of doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every document, as a scratch table."""
    return materialize(docs.select("doc_id", _features("text").alias("f")).select("doc_id", "f.*"), "features")


def train(features: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """The model of at most max_rows labelled rows that aren't held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("doc_id"))
    rows = features.join(known, "doc_id").withColumn("hash", F.xxhash64("doc_id", *FEATURES))
    share = min(1.0, 1.5 * max_rows / max(1, rows.count()))  # else each task would send max_rows rows to the driver
    near = rows.where(F.pmod("hash", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = near.orderBy("hash", "doc_id", "y").limit(max_rows).select(*FEATURES, "y").toPandas()
    return fit([sample[f].to_numpy(float) for f in FEATURES], sample["y"].to_numpy(float))


def score(features: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    @F.pandas_udf(T.DoubleType())
    def added(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score([c.to_numpy(float) for c in columns]))

    rows = features.select("doc_id", held_out("doc_id").alias("held_out"), added.asNondeterministic()(*FEATURES).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Train on the labels and score every document."""
    features = featurize(docs)
    return score(features, train(features, labels, label))
