"""BPE encoding and decoding: the distinct words of a batch as a trie, whose prefixes are encoded once.

The encoding of a prefix is that of a shorter prefix and one token more, its last. So a prefix's state is its last token,
and a depth-first walk of the trie hands the states of a path down: at each node the last token is the one vocabulary entry
that ends there and fits behind the last token of the prefix before it. Two tokens fit if merging their bytes never joins
across them, which their halves and the merges' ranks decide. Words with a common prefix share its states, and a word's
ids are read back from its end. The words in order are that walk: what a word shares with the one before is the path down
to their fork.

The entries that end at a node come from a second trie, that of the vocabulary, whose nodes link to their longest ends
that are nodes too.

Texts are split into words as the vocabulary's byte-level pre-tokenizer does, special tokens taken out first where asked
for. Words are encoded once for each batch of texts, and kept for the next ones within KEPT; very long words follow
a path by themselves, so no trie holds them. Long texts are split at places that no word reaches across.

Defined results: null and empty texts have no ids and decode to an empty text; bytes that aren't UTF-8 decode to
replacement characters; rows are independent, so repeated rows, null ids and an empty table need nothing special; encode()
and decode() keep other columns but for one with the name asked for the result, which gives way; an id that isn't in the
vocabulary is an error.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import safe_pieces

#: Words whose ids a worker keeps (twice as many with the aged), the longest of them in characters, and the characters of
#: text whose words are held at once.
KEPT, LONGEST, HELD = 300_000, 200, 1_000_000
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 characters are themselves, others follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def _unsettled() -> np.ndarray:
    """For each code point whether it has no category in this Python's Unicode; libraries of other versions disagree on those."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's format, and the words it has encoded so far."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        top = max(max(self.ids.values()), *self.special.values(), 0) + 1
        self.bytes = [b""] * top
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.sizes = [len(b) for b in self.bytes]
        self.packed = [i.to_bytes(4, "little") for i in range(top)]
        self.words, self.own = regex.compile(pattern), Tokenizer.from_file(path).pre_tokenizer
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._learn(model["merges"])
        self.known: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.fit: dict[int, bool] = {}
        self.moves: dict[int, int] = {}

    def _learn(self, merges: list) -> None:
        """Ranks of merges; for each token the pieces at its right and left edge while it is made, with the rank that ends each."""
        letters = byte_letters()
        plain = lambda token: self.ids[bytes(letters[c] for c in token)]
        self.rank, made = {}, {}
        self.right = {i: [(i, NEVER)] for i in self.ids.values()}
        self.left = {i: [(i, NEVER)] for i in self.ids.values()}
        for rank, pair in enumerate(merges):
            a, b = map(plain, pair.split(" ") if isinstance(pair, str) else pair)
            whole = self.ids[self.bytes[a] + self.bytes[b]]
            if max(made.get(a, -1), made.get(b, -1)) >= rank or whole in made:
                raise ValueError("a merge comes before its halves, or twice")
            self.rank[a, b] = made[whole] = rank
            self.right[whole] = [(whole, NEVER), (b, rank), *self.right[b][1:]]
            self.left[whole] = [(whole, NEVER), (a, rank), *self.left[a][1:]]
        self._plant()

    def _plant(self) -> None:
        """The vocabulary's trie: for each node its longest end that is a node, and the longest token that ends there."""
        self.edges, self.ends, self.longest, self.shorter = {}, [0], [-1], {}
        node = {b"": 0}
        for start in sorted({token[:n] for token in self.ids for n in range(1, len(token) + 1)}, key=len):
            above = node[start[:-1]]
            end = self._beyond(self.ends[above], start[-1]) if above else 0
            self.edges[above << 8 | start[-1]] = node[start] = len(self.ends)
            self.ends.append(end)
            token = self.ids.get(start)
            if token is not None:
                self.shorter[token] = self.longest[end]
            self.longest.append(self.longest[end] if token is None else token)

    def _beyond(self, node: int, b: int) -> int:
        """The node of the longest end of a node's bytes and one byte more."""
        while (below := self.edges.get(node << 8 | b)) is None:
            node = self.ends[node]
        return below

    def move(self, key: int) -> int:
        """_beyond() of a node and a byte in one number, remembered."""
        if len(self.moves) > 20 * KEPT:
            self.moves.clear()
        self.moves[key] = node = self._beyond(key >> 8, key & 255)
        return node

    def fits(self, before: int, after: int) -> bool:
        """Whether two tokens side by side stay two: no merge joins a piece at the one's end to a piece at the other's start."""
        if len(self.fit) > 20 * KEPT:
            self.fit.clear()
        found = not any((rank := self.rank.get((a, b))) is not None and rank < end_a and rank <= end_b for a, end_a in self.right[before] for b, end_b in self.left[after])
        self.fit[before << 32 | after] = found
        return found

    def follow(self, word: bytes, last: list[int], nodes: list[int]) -> None:
        """The states of a word's prefixes, behind those that are there: the last token, and the node of the longest end."""
        moves, longest, sizes, fit, node = self.moves, self.longest, self.sizes, self.fit, nodes[-1]
        for depth in range(len(nodes), len(word) + 1):
            key = node << 8 | word[depth - 1]
            node = moves.get(key) or self.move(key)
            token = longest[node]
            while start := depth - sizes[token]:
                fits = fit.get(last[start] << 32 | token)
                if fits or fits is None and self.fits(last[start], token):
                    break
                token = self.shorter[token]
            last.append(token)
            nodes.append(node)

    def read_back(self, last: list[int], depth: int) -> bytes:
        """The ids of the path down to a depth, as little-endian 32-bit integers."""
        ids = []
        while depth:
            token = last[depth]
            ids.append(self.packed[token])
            depth -= self.sizes[token]
        return b"".join(ids[::-1])

    def learn_words(self, words: Iterable[str]) -> None:
        """Walk the trie of words depth first; ids go to `known`. Words in the order of their code points are in that of their bytes."""
        before, last, nodes = b"", [-1], [0]
        for text in sorted(words):
            word, fork, most = text.encode(), 0, len(before)
            while fork < most and before[fork] == word[fork]:
                fork += 1
            del last[fork + 1 :], nodes[fork + 1 :]
            self.follow(word, last, nodes)
            self.known[text] = self.read_back(last, len(word))
            before = word

    def long_word(self, word: str) -> bytes:
        path, last = word.encode(), [-1]
        self.follow(path, last, [0])
        return self.read_back(last, len(path))

    def split(self, text: str) -> list[str]:
        if not text.isascii() and _unsettled()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
        return self.words.findall(text)

    def encode_words(self, words: list[list[str]]) -> list[bytes]:
        """The ids of each list of words, those not met before through a trie. Of the words kept, those not met again for long go."""
        fresh = {w for w in set().union(*words) if w not in self.known}
        old = {w for w in fresh if w in self.aged}
        self.known.update((w, self.aged[w]) for w in old)
        fresh -= old
        short = {w for w in fresh if len(w) <= LONGEST}
        self.learn_words(short)
        long = {w: self.long_word(w) for w in fresh - short}
        find = (lambda w: self.known.get(w) or long[w]) if long else self.known.__getitem__
        found = [b"".join(map(find, x)) for x in words]
        if len(self.known) > KEPT:
            self.known, self.aged = {}, self.known
        return found

    def pieces(self, text: str, special: bool) -> Iterator[str | int]:
        """The text's parts in order; a special token as its id."""
        for part in self.split_special.split(text) if special and self.split_special else [text]:
            if special and part in self.special:
                yield self.special[part]
            elif part:
                yield from safe_pieces(part, HELD)

    def encode_all(self, texts: Iterable[str | None], special: bool = True) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; special tokens in a text are such, or else plain text."""
        parts: list[list[bytes]] = []
        waiting: list[tuple[int, int, list[str]]] = []
        held = 0

        def settle() -> None:
            for (text, place, _), ids in zip(waiting, self.encode_words([w for _, _, w in waiting]), strict=True):
                parts[text][place] = ids
            waiting.clear()

        for i, text in enumerate(texts):
            parts.append([])
            for part in self.pieces(text, special) if text else ():
                if isinstance(part, int):
                    parts[i].append(np.array([part], "<u4").tobytes())
                    continue
                waiting.append((i, len(parts[i]), self.split(part)))
                parts[i].append(b"")
                held += len(part)
                if held >= HELD:
                    settle()
                    held = 0
        settle()
        return [b"".join(x) for x in parts]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once for each worker; the path must be readable on every executor."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", special: bool = True) -> DataFrame:
    """docs with the token ids of its text column."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def to_ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<i4") for x in vocabulary(path, pattern).encode_all(texts, special)], dtype=object)

    return docs.withColumn(ids, to_ids(text))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of its ids column."""

    @F.pandas_udf(T.StringType())
    def to_text(lists: pd.Series) -> pd.Series:
        vocab = vocabulary(path, pattern)
        return pd.Series(["" if x is None else vocab.decode_bytes(x.tolist()).decode("utf-8", "replace") for x in lists], dtype=object)

    return rows.withColumn(out, to_text(ids))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to, for every whole text; one pass."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        vocab, rows = vocabulary(path, pattern), []
        for packed in vocab.encode_all(texts):
            text = vocab.decode_bytes(np.frombuffer(packed, "<u4").tolist()).decode("utf-8", "replace")
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
