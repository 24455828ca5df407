"""Cross-tokenizer alignment: two tokenizers' ids of one text, cut where tokens of both end, by an associative fragment monoid.

A text is the bytes of a space and the document's text. Tokenizer A is a byte-level BPE vocabulary, B a sentencepiece model
that puts the space before the text itself. A stretch of both token streams is a fragment: an open prefix (tokens up to the
first place where both streams end a token), closed groups, and an open suffix (tokens after the last such place); without
such a place all is open. Two neighbours compose by aligning what lies open between them, which is associative, so a very
long document is cut into byte ranges, each encoded by another Spark task, and composed as a tree, FAN fragments at a time.
Each stream is cut where its own tokenizer can't reach across, at or after the range's end, so the two streams of a
fragment needn't begin or end at one place.

A link is an A token and a B token that share bytes. Places where either stream ends a token cut the text into stretches,
and each stretch is one link. Links of equal ids are counted in each fragment, summed over the corpus by partial
aggregation, and the sums written. They come back to the documents in blocks of at most PAIRS rows, by a hash of the pair:
a block is small enough to broadcast, whatever the corpus, and each block adds its share to a document's sums, so
neither a frequent pair nor a long document makes a large group.

Defined results: null and empty texts, and texts for which either tokenizer's bytes aren't the text's (characters that B
takes for its space sign), have zeros and an empty digest, and add no links; rows are aligned one by one, so rows equal in
doc_id, and those with a null one, each give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode_text
from .common import materialize
from .trie_bpe import byte_letters

#: Characters of a byte range; longer texts are cut. Fragments composed at once. Pairs broadcast at once.
RANGE, FAN, PAIRS = 500_000, 8, 1 << 20
_A_CUT, _B_CUT = regex.compile(r"\S(?=\s)"), regex.compile("[^ ](?= )")


class Ranks:
    """A byte-level vocabulary in the tokenizers library's format, encoded by tiktoken with its ids as ranks, which for such a vocabulary come in the order of its merges."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return encode_text(self.encoding, text)


class Pieces:
    """A sentencepiece model whose pieces never hold the space sign behind another character, so that a text can be cut there."""

    def __init__(self, path: str) -> None:
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind another character: texts can't be cut for their encoding")
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.space = m.piece_to_id("▁")

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of a text that begins with a space, which the model puts there itself; None if their bytes aren't the text's."""
        ids = [self.space] if text == " " else self.model.encode(text[1:])
        right = b"".join(map(self.bytes.__getitem__, ids)) == text.encode()
        return np.array(ids, np.int32) if right else None


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, pattern: str, path_b: str) -> tuple[Ranks, Pieces]:
    """Loaded once for each worker; the paths must be readable on every executor."""
    return Ranks(path_a, pattern), Pieces(path_b)


class Stream(NamedTuple):
    """Consecutive tokens: ids, and the byte at which each ends."""

    ids: np.ndarray
    ends: np.ndarray

    def cut(self, at: int) -> tuple[Stream, Stream]:
        """The tokens that end at a byte or before, and the others."""
        n = int(np.searchsorted(self.ends, at, "right"))
        return Stream(self.ids[:n], self.ends[:n]), Stream(self.ids[n:], self.ends[n:])

    def __add__(self, other: Stream) -> Stream:
        return Stream(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))


NOTHING = Stream(np.empty(0, np.int32), np.empty(0, np.int64))


@functools.cache
def _names(n: int) -> tuple[np.ndarray, ...]:
    """Ids below n as decimals followed by a comma, a bar and a semicolon."""
    return tuple(np.array([f"{i}{mark}" for i in range(n)], object) for mark in ",|;")


def groups_of(a: Stream, b: Stream, common: np.ndarray) -> str:
    """The groups that end at the common places, as a1,a2|b1;a3|b2,b3; with a mark at the end of each."""
    within, closing, ending = _names(1 << max(17, int(max(a.ids.max(), b.ids.max())).bit_length()))
    text_a, text_b = within[a.ids], within[b.ids]
    last_a, last_b = np.searchsorted(a.ends, common), np.searchsorted(b.ends, common)
    text_a[last_a], text_b[last_b] = closing[a.ids[last_a]], ending[b.ids[last_b]]
    place = np.concatenate([2 * np.searchsorted(common, a.ends), 2 * np.searchsorted(common, b.ends) + 1])
    return "".join(np.concatenate([text_a, text_b])[np.argsort(place, kind="stable")].tolist())


def ends_of(a: Stream, b: Stream) -> tuple[np.ndarray, np.ndarray]:
    """The bytes at which either stream ends a token, and those at which both do."""
    ends = np.concatenate([a.ends, b.ends])
    ends.sort(kind="stable")  # which merges sorted runs
    again = ends[1:] == ends[:-1]
    return ends[np.concatenate([np.ones(min(1, len(ends)), bool), ~again])], ends[1:][again]


def links_of(a: Stream, b: Stream, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (A's id in the upper half, B's in the lower) of tokens that share bytes, and how often each comes; ends of either stream, which end at one byte."""
    pair = a.ids[np.searchsorted(a.ends, ends)].astype(np.int64) << 32 | b.ids[np.searchsorted(b.ends, ends)]
    return np.unique(pair, return_counts=True)


class Fragment(NamedTuple):
    """An element of the monoid. closed: whether there is a common end; if not, all tokens are in the prefix."""

    prefix: tuple[Stream, Stream]
    closed: bool
    groups: str
    links: tuple[np.ndarray, np.ndarray]
    suffix: tuple[Stream, Stream]


EMPTY = Fragment((NOTHING, NOTHING), False, "", (np.empty(0, np.int64), np.empty(0, np.int64)), (NOTHING, NOTHING))


def fragment(a: Stream, b: Stream) -> Fragment:
    """The fragment of two token streams."""
    common = ends_of(a, b)[1]
    if not len(common):
        return EMPTY._replace(prefix=(a, b))
    (head_a, a), (head_b, b) = a.cut(common[0]), b.cut(common[0])
    (mid_a, tail_a), (mid_b, tail_b) = a.cut(common[-1]), b.cut(common[-1])
    return Fragment((head_a, head_b), True, *closing(mid_a, mid_b), (tail_a, tail_b))


def _sum(*links: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in links]), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in links]))
    return pairs, counts


def closing(a: Stream, b: Stream) -> tuple[str, tuple[np.ndarray, np.ndarray]]:
    """Groups and links of streams that begin at one byte and end at one."""
    ends, common = ends_of(a, b)
    return (groups_of(a, b, common), links_of(a, b, ends)) if len(common) else ("", EMPTY.links)


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of both in a row. Only what lies open between them is looked at."""
    open_left = left.suffix if left.closed else left.prefix
    middle = fragment(open_left[0] + right.prefix[0], open_left[1] + right.prefix[1])
    if not middle.closed:  # so neither has a prefix of the right one closed, nor the left one's suffix
        if left.closed:
            return left._replace(suffix=middle.prefix)
        return middle
    groups, links, prefix = left.groups, left.links, left.prefix
    if left.closed:
        text, more = closing(*middle.prefix)
        groups, links = groups + text, _sum(links, more)
    else:
        prefix = middle.prefix
    groups, links, suffix = groups + middle.groups, _sum(links, middle.links), middle.suffix
    if right.closed:  # whose first common end is the middle's last
        groups, links, suffix = groups + right.groups, _sum(links, right.links), right.suffix
    return Fragment(prefix, True, groups, links, suffix)


def finish(whole: Fragment) -> tuple[int, str, tuple[np.ndarray, np.ndarray]]:
    """Number of groups, their text and the links of a whole text's fragment, whose prefix is its first group."""
    text, links = closing(*whole.prefix)
    text = (text + whole.groups)[:-1]
    return text.count(";") + 1, text, _sum(links, whole.links) if whole.closed and len(whole.links[0]) else links


def ranges(text: str, size: int) -> list[tuple[str, int, str, int]]:
    """A space and the text, cut for both tokenizers: A's part, its first byte, B's part and its first byte, for each range of so many characters."""
    text = " " + text
    marks = range(size, len(text), size)

    def cuts(expression: regex.Pattern) -> list[int]:
        found, low = [0], 0
        for mark in marks:
            if low is not None and mark > low:
                m = expression.search(text, mark - 1)
                low = m.end() if m else None
            found.append(len(text) if low is None else low)
        return [*found, len(text)]

    def parts(expression: regex.Pattern) -> list[tuple[str, int]]:
        places = cuts(expression)
        out = [text[i:j] for i, j in itertools.pairwise(places)]
        return list(zip(out, itertools.accumulate((len(x.encode()) for x in out[:-1]), initial=0), strict=True))

    return [(*a, *b) for a, b in zip(parts(_A_CUT), parts(_B_CUT), strict=True)]


def streams(a: Ranks, b: Pieces, part_a: str, at_a: int, part_b: str, at_b: int) -> tuple[Stream, Stream] | None:
    """Both token streams of a range; None if B doesn't give the text's bytes back, as a byte-level vocabulary always does."""
    ids_b = b.encode(part_b) if part_b else NOTHING.ids
    if ids_b is None:
        return None
    ids_a = a.encode(part_a)
    return Stream(ids_a, np.cumsum(a.sizes[ids_a]) + at_a), Stream(ids_b, np.cumsum(b.sizes[ids_b]) + at_b)


# doc_id travels as text: pandas would make floats of integers beside nulls
_RESULT = "row long, doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, counts array<long>"
_PART = "row long, doc_id string, nth long, part_a string, at_a long, part_b string, at_b long"
_FRAGMENT = "row long, doc_id string, nth long, valid boolean, n_a long, n_b long, closed boolean, groups string, pairs array<long>, counts array<long>, " + ", ".join(f"{side}_{kind} array<{t}>" for side in ("head_a", "head_b", "tail_a", "tail_b") for kind, t in (("ids", "int"), ("ends", "long")))


def _result(row: int, doc_id: object, sizes: tuple[int, int], whole: Fragment | None) -> tuple:
    if whole is None:
        return row, doc_id, 0, 0, 0, "", [], []
    n, text, (pairs, counts) = finish(whole)
    return row, doc_id, *sizes, n, hashlib.sha256(text.encode()).hexdigest(), pairs, counts


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _pack(row: int, doc_id: object, nth: int, sizes: tuple[int, int], f: Fragment | None) -> tuple:
    valid, f = f is not None, f or EMPTY
    return row, doc_id, nth, valid, *sizes, f.closed, f.groups, *f.links, *(x for side in (*f.prefix, *f.suffix) for x in side)


def _unpack(r: object) -> Fragment | None:
    if not r.valid:
        return None
    side = lambda name: Stream(np.asarray(getattr(r, name + "_ids"), np.int32), np.asarray(getattr(r, name + "_ends"), np.int64))
    return Fragment((side("head_a"), side("head_b")), r.closed, r.groups, (np.asarray(r.pairs, np.int64), np.asarray(r.counts, np.int64)), (side("tail_a"), side("tail_b")))


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, text: str = "text", size: int = RANGE, fan: int = FAN) -> DataFrame:
    """row (a number for each row, below 0 if it was cut), doc_id, n_a, n_b, n_groups, groups_sha256, and a document's pairs with their counts."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))
    short = F.coalesce(F.length("text") < size, F.lit(True))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = tokenizers(path_a, pattern, path_b)
        for batch in batches:
            rows = []
            for row, doc_id, t in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                both = streams(a, b, " " + t, 0, " " + t, 0) if t else None
                # one range is a whole text, so all of it is the prefix of its first and only composition
                rows.append(_result(row, doc_id, tuple(len(x.ids) for x in both or ()), EMPTY._replace(prefix=both) if both else None))
            yield _frame(rows, _RESULT)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, t in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                yield _frame([(-1 - row, doc_id, nth, *x) for nth, x in enumerate(ranges(t, size))], _PART)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = tokenizers(path_a, pattern, path_b)
        for batch in batches:
            for r in batch.itertuples():
                both = streams(a, b, r.part_a, r.at_a, r.part_b, r.at_b)
                yield _frame([_pack(r.row, r.doc_id, r.nth, tuple(len(x.ids) for x in both) if both else (0, 0), fragment(*both) if both else None)], _FRAGMENT)

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("nth")
        found = list(map(_unpack, part.itertuples()))
        first = part.iloc[0]
        merged = None if any(f is None for f in found) else functools.reduce(compose, found)
        return _frame([_pack(first["row"], first.doc_id, first.nth // fan, (part.n_a.sum(), part.n_b.sum()), merged)], _FRAGMENT)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([_result(r.row, r.doc_id, (r.n_a, r.n_b), _unpack(r)) for r in batch.itertuples()], _RESULT)

    parts = materialize(docs.where(~short).mapInPandas(split, _PART), "ranges")
    left = (parts.agg(F.max("nth")).first()[0] or 0) + 1
    fragments = parts.repartition("row", "nth").mapInPandas(encode, _FRAGMENT)
    while left > 1:
        fragments, left = fragments.groupBy("row", (F.col("nth") / fan).cast("long").alias("nth_")).applyInPandas(reduce, _FRAGMENT), -(-left // fan)
    rows = docs.where(short).mapInPandas(whole, _RESULT).unionByName(fragments.mapInPandas(end, _RESULT))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links of the whole corpus) and best (whether it is the highest of its B id), written. B's ids are a vocabulary, so their table is broadcast."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = materialize(links.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def correspond(docs: DataFrame, path_a: str, pattern: str, path_b: str, size: int = RANGE, fan: int = FAN, block: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    aligned = materialize(align(docs, path_a, pattern, path_b, size=size, fan=fan), "aligned", "zstd")
    counts = materialize(pair_counts(aligned), "counts")
    blocks = max(1, -(-counts.count() * 5 // (block * 4)))  # a fifth of room, as hashes fill blocks unevenly
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    nth = F.pmod(F.xxhash64("pair"), F.lit(blocks))
    sums = None
    for i in range(blocks):
        mine = links.join(F.broadcast(counts.where(nth == i)), "pair")
        part = mine.groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
        if blocks > 1:
            part = materialize(part, "sums")
        sums = part if sums is None else sums.unionByName(part)
    if blocks > 1:
        sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return aligned.drop("pairs", "counts").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256")
