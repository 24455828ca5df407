"""Encoding through a trie beside the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import none, odd, shipped  # noqa: F401
from tokenizers import Tokenizer

from provlake.llm import common, queries, trie_bpe

PARTS = ["a", "aaaa", " ", "  ", "\n", "é", "<|endoftext|>", "the", "'s", "12", "!!", "日", "\U0001f600", "\x1c", "\x85", "\xa0", "ab", "ing", "\u0558", "\U0002b73b", "\x00", "\u2581"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocab():
    return trie_bpe.Vocabulary(queries.VOCABULARY, queries.PATTERN)


@pytest.mark.parametrize("letters", [PARTS, "abetinos", "a=- ", ["ab", "\n", "x" * 250, "0"]])
@pytest.mark.parametrize("special", [True, False])
def test_words_as_the_library_has_them(vocab, library, letters, special):
    r = random.Random(len(letters))
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)] + ["ab" * 40_000, "a" * 70_001, " " * 70_001 + "x", None]
    library.encode_special_tokens = not special
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocab.encode_all(texts, special)] == want


def test_few_words_kept_and_texts_cut(library, monkeypatch):
    """Aged words, long words and cut texts change nothing."""
    for name, value in {"KEPT": 7, "LONGEST": 5, "HELD": 40}.items():
        monkeypatch.setattr(trie_bpe, name, value)
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "theory", "theorem", "a", "\n\n", "internationally", "<|endoftext|>", "zq"]) for _ in range(60)) for _ in range(50)]
    library.encode_special_tokens = False
    small = trie_bpe.Vocabulary(queries.VOCABULARY, queries.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_all(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small.known) <= 7 + 8


def test_words_in_order_are_the_trie(vocab, monkeypatch):
    """Each prefix that words share is followed once, whatever the words' order; words that others begin with, and ends shared by none."""
    seen, follow = [], vocab.follow
    monkeypatch.setattr(vocab, "follow", lambda word, last, nodes: seen.append(len(word) + 1 - len(nodes)) or follow(word, last, nodes))
    words = ["theory", "the", "\U0001f600", "theorem", "\uffee", "t", "é", "èx", "zq"]
    r = random.Random(5)
    for _ in range(5):
        r.shuffle(words)
        seen.clear()
        vocab.learn_words(words)
        assert sum(seen) == len({w.encode()[:n] for w in words for n in range(1, len(w.encode()) + 1)})
        assert all(vocab.known[w] == vocab.long_word(w) for w in words)


def test_whole_table(spark, data, library):
    library.encode_special_tokens = False
    texts = {r.doc_id: r.text or "" for r in common.table(spark, data, "documents").collect()}
    got = {r.doc_id: r for r in queries.queries()["op13_trie_bpe"](spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, odd, none, library):  # noqa: F811
    docs = odd.withColumn("ids", F.lit("clash"))
    rows = trie_bpe.decode(trie_bpe.encode(docs, queries.VOCABULARY, queries.PATTERN), queries.VOCABULARY, queries.PATTERN).collect()
    assert len(rows) == odd.count() and all(r.decoded == (r.text or "") and r.kept == "k" for r in rows)
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert trie_bpe.round_trip(none, queries.VOCABULARY, queries.PATTERN).count() == 0
    broken = spark.createDataFrame([([255, 254, 0],), (None,)], "ids array<int>")
    assert [r.decoded for r in trie_bpe.decode(broken, queries.VOCABULARY, queries.PATTERN).collect()] == [library.decode([255, 254, 0], skip_special_tokens=False), ""]
