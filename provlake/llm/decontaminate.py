"""Benchmark decontamination by a generalised suffix automaton.

The automaton is built over the normalised words of all test items and knows every run of words that occurs in any of
them. Training texts stream through it word by word; at each word it holds the longest run that ends there and occurs in
an item. Where that run reaches a window (WINDOW words, or a whole shorter item), the window's words are hit, and the
items are read from the automaton's state. Words are looked up first, and only stretches in which each pair of
neighbouring words also stands side by side in some item are streamed: elsewhere no run gets beyond one word.

The items are gathered in blocks of about BLOCK_WORDS words, one at a time, each of which becomes one broadcast automaton;
a larger set of items takes more passes over the texts, not more memory: between passes the rows go to a scratch table, so
no task holds two automata. One item isn't divided: a block is as large as the largest item at least.

clean() takes out hit spans of at least MIN_SPAN words, and drops documents of which more than MAX_COVERAGE is hit.

Defined results: null, empty and wordless texts have no words and are clean; wordless items are ignored; repeated items
with one item_id count once; null item_id takes part in hits but isn't listed; an empty benchmark hits nothing; rows are
independent; other columns are ignored by scan() and kept by clean().
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

WINDOW = 10
#: Words of items in one automaton, about 1 KB of Python objects each.
BLOCK_WORDS = 200_000
MIN_SPAN = 1
MAX_COVERAGE = 0.5

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters in lower case; words are runs of letters, digits and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """All runs of words of the items. A state stands for runs with the same places of ending; link leads to the longest shorter ones."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set] = [set()]
        ends: list[tuple[int, int, int]] = []
        self.pairs: set[int] = set()
        for number, (_, words) in enumerate(items):
            row = [self.ids.setdefault(w, len(self.ids)) for w in words]
            self.pairs.update(a << 32 | b for a, b in pairwise(row))
            last = 0
            for at, word in enumerate(row):
                last = self._extend(last, word, owners)
                owners[last].add(number)
                if at + 1 == len(row) < window:
                    ends.append((last, len(row), number))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                owners[self.link[state]] |= owners[state]
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.short: dict[tuple[int, int], set[int]] = {}  # (state, words): short items that are this run
        for state, n, number in ends:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            self.short.setdefault((state, n), set()).add(number)
        self.short_at: dict[int, list[int]] = {}
        for state, n in self.short:
            self.short_at.setdefault(state, []).append(n)
        self.owners = [frozenset(x) for x in owners]
        self.least = min([window, *(n for _, n in self.short)])

    def _extend(self, last: int, word: int, owners: list[set]) -> int:
        if word in self.next[last]:
            seen = self.next[last][word]
            return seen if self.length[seen] == self.length[last] + 1 else self._split(last, word, seen, owners)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        owners.append(set())
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            seen = self.next[p][word]
            self.link[state] = seen if self.length[seen] == self.length[p] + 1 else self._split(p, word, seen, owners)
        return state

    def _split(self, p: int, word: int, seen: int, owners: list[set]) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[seen]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[seen])
        owners.append(set(owners[seen]))
        self.link[seen] = copy
        while p >= 0 and self.next[p].get(word) == seen:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (first word, word after the last), merged and in order, and the numbers of the items met."""
        get, n = self.ids.get, len(words)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
        spans: list[tuple[int, int]] = []
        met: set[int] = set()
        for start, end in self._stretches(ids):
            self._stream(ids[start:end].tolist(), start, spans, met)
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged], met

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal stretches of known words whose neighbours also stand side by side in an item, long enough for a window."""
        if not len(ids):
            return
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.flatnonzero(joined)
        if len(at) and len(self.keys):
            pair = ids[at] << 32 | ids[at + 1]
            joined[at] = self.keys[np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)] == pair
        else:
            joined[:] = False
        edges = np.flatnonzero(~np.concatenate([[False], joined, [False]]))  # places before which no pair holds
        starts, ends = edges[:-1], edges[1:]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= self.least and ids[a] >= 0:
                yield a, b

    def _stream(self, ids: list[int], base: int, spans: list[tuple[int, int]], met: set[int]) -> None:
        state, run, window = 0, 0, self.window
        for at, word in enumerate(ids, base + 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if word in self.next[state]:
                state, run = self.next[state][word], run + 1
            if run >= window:
                spans.append((at - window, at))
                whole = state
                while self.length[self.link[whole]] >= window:
                    whole = self.link[whole]
                met |= self.owners[whole] if self.length[whole] >= window else frozenset()
            if self.short:
                self._short(state, run, at, spans, met)

    def _short(self, state: int, run: int, at: int, spans: list[tuple[int, int]], met: set[int]) -> None:
        while state > 0:
            for n in self.short_at.get(state, ()):
                if n <= run:
                    spans.append((at - n, at))
                    met |= self.short[state, n]
            state = self.link[state]


class _Blocks:
    """The items in blocks of about block_words words; their number comes from a count of all words.

    A block is gathered when a pass needs it and forgotten after it, so the driver holds one block at a time. Blocks are
    told apart by a hash of the item, so each pass gets the same ones.
    """

    def __init__(self, benchmark: DataFrame, block_words: int):
        self.items = benchmark.select("item_id", "text").where("text is not null").distinct()
        total = self.items.agg(F.sum(F.length("text"))).first()[0] or 0
        self.number = max(1, math.ceil(total / 2 / block_words))

    def __len__(self) -> int:
        return self.number

    def __iter__(self) -> Iterator[list[tuple[int | None, str]]]:
        if self.number > 1:
            self.items = materialize(self.items, "items")
        for k in range(self.number):
            part = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.number)) == k
            yield [tuple(r) for r in self.items.where(part).collect()]


@functools.lru_cache(maxsize=1)
def _automaton(held: _Held, window: int) -> tuple[SuffixAutomaton, list[int | None]]:
    items = [(i, w) for i, t in held.items if (w := words_of(t))]
    return SuffixAutomaton(items, window), [i for i, _ in items]


class _Held:
    """A block of items that hashes by its digest, so that each Python worker builds its automaton once."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.key = hashlib.sha256(repr(self.items).encode("utf-8", "surrogatepass")).hexdigest()

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Held) and other.key == self.key


MATCHES = "n_words long, spans array<struct<first:int,after:int>>, item_ids array<long>"


def _finder(shared: Broadcast, window: int):
    def find(texts: pd.Series) -> pd.DataFrame:
        automaton, names = _automaton(shared.value, window)
        out = []
        for t in texts:
            words = words_of(t)
            spans, met = automaton.scan(words)
            out.append((len(words), spans, sorted({names[k] for k in met} - {None})))
        return pd.DataFrame(out, columns=["n_words", "spans", "item_ids"])

    return F.pandas_udf(find, MATCHES).asNondeterministic()  # so that no filter copies it


def _cutter(shared: Broadcast, window: int, min_span: int):
    def cut(texts: pd.Series) -> pd.DataFrame:
        automaton, _ = _automaton(shared.value, window)
        return pd.DataFrame([cut_out(automaton, t, min_span) for t in texts], columns=["text", "n_hit", "n_words"])

    return F.pandas_udf(cut, "text string, n_hit long, n_words long").asNondeterministic()


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, firsts: pd.Series, afters: pd.Series) -> pd.Series:
    return pd.Series([cut_words(t, list(zip(a, b, strict=True))) if len(a) else t for t, a, b in zip(texts, firsts, afters, strict=True)], dtype=object)


def match(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rows with a struct column __match: n_words, the hit spans in words, and the sorted item_ids with occurring windows."""
    return _match(spark, rows, _Blocks(benchmark, block_words), text, window)


def _match(spark: SparkSession, rows: DataFrame, blocks: _Blocks, text: str, window: int) -> DataFrame:
    """With several blocks, each pass is written before the next block is gathered, and its broadcast and table go then."""
    shared, table = None, None
    for number, block in enumerate(blocks):
        if number:
            rows, last = materialize(rows, "matched"), table
            shared.destroy()
            if last is not None:
                discard(last)
            table = rows
        shared = spark.sparkContext.broadcast(_Held(block))
        found = _finder(shared, window)(text)
        if not number:
            rows = rows.withColumn("__match", found)
        else:
            both = rows.withColumn("__more", found)
            spans = _merged("array_sort(concat(__match.spans, __more.spans))")
            names = F.array_sort(F.array_union("__match.item_ids", "__more.item_ids"))
            rows = both.withColumn("__match", F.struct(F.col("__match.n_words").alias("n_words"), spans.alias("spans"), names.alias("item_ids"))).drop("__more")
    return rows


def _merged(spans: str) -> Column:
    """Sorted spans as disjoint ones."""
    step = """aggregate({0}, cast(array() as array<struct<first:int,after:int>>), (acc, x) ->
        if(size(acc) > 0 and x.first <= element_at(acc, -1).after,
           concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).first as first, greatest(element_at(acc, -1).after, x.after) as after))),
           concat(acc, array(x))))"""
    return F.expr(step.format(spans))


def _hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rows = match(spark, docs.select("doc_id", "text"), benchmark, window=window).select("doc_id", "__match.*")
    hit = _hit(F.col("spans"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "item_ids")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them; a line break stays in their place."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data)]
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : at[a][0]])
        done = at[b - 1][1]
    return b"\n".join([*out, data[done:]]).decode("utf-8", "surrogatepass")


def cut_out(automaton: SuffixAutomaton, text: str | None, min_span: int) -> tuple[str | None, int, int]:
    """The text without its hit spans of min_span words or more (null if it has none), the hit words, and all words.

    A cut can bring words together that form a new window, so the text is cut until nothing is hit.
    """
    words = words_of(text)
    n, lost, out = len(words), 0, None
    while spans := automaton.scan(words)[0]:
        lost = lost or sum(b - a for a, b in spans)
        spans = [(a, b) for a, b in spans if b - a >= min_span]
        if not spans:
            break
        out = cut_words(text if out is None else out, spans)
        words = words_of(out)
    return out, lost, n


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without documents of which more than max_coverage is hit, and the others without hit spans of min_span words or more.

    One block of items is matched and cut in one pass. With several, the spans of all blocks are taken from the same text,
    their union decides coverage and is cut at once, and rows that were cut are gone through again until nothing is hit, so
    the result doesn't depend on the blocks. n_chars follows the new text.
    """
    blocks = _Blocks(benchmark, block_words)
    if len(blocks) == 1:
        cut = _cutter(spark.sparkContext.broadcast(_Held(next(iter(blocks)))), window, min_span)
        rows = docs.withColumn("__cut", cut("text")).withColumns({"text": F.coalesce("__cut.text", "text"), "__hit": F.col("__cut.n_hit"), "__words": F.col("__cut.n_words")})
        rows = rows.where(F.col("__hit") <= max_coverage * F.col("__words"))
    else:
        rows = _clean_in_rounds(spark, docs, blocks, min_span, max_coverage, window)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("__hit") > 0, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def _clean_in_rounds(spark: SparkSession, docs: DataFrame, blocks: _Blocks, min_span: int, max_coverage: float, window: int) -> DataFrame:
    """docs as clean() cuts them, with __hit, the words that the first round hits; only rows that a round cuts enter the next."""
    settled: list[DataFrame] = []
    rows = docs
    while not settled or not rows.isEmpty():
        rows = _match(spark, rows, blocks, "text", window)
        if not settled:
            rows = rows.withColumn("__hit", _hit(F.col("__match.spans"))).where(F.col("__hit") <= max_coverage * F.col("__match.n_words"))
        rows = rows.withColumn("__spans", F.filter("__match.spans", lambda x: x["after"] - x["first"] >= min_span))
        rows = rows.withColumns({"__again": F.size("__spans") > 0, "text": _cut("text", "__spans.first", "__spans.after")})
        rows = materialize(rows.drop("__match", "__spans"), "cut")
        settled.append(rows.where(~F.col("__again")).drop("__again"))
        rows = rows.where("__again").drop("__again")
    return functools.reduce(DataFrame.unionByName, settled)
