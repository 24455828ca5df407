"""Alignment of two tokenizers beside both libraries and a plain reading of the streams."""

import functools
import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import none, odd, shipped  # noqa: F401
from tokenizers import Tokenizer

from provlake.llm import alignment, common, queries, trie_bpe

PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "é", "<|endoftext|>", "<s>", "the", "'s", "123", "!!", "日本語", "\U0001f600", "ing", "tion", "\x00", "\t", "x" * 110, "\u3000"]


@pytest.fixture(scope="module")
def plain():
    """n_a, n_b, groups and links of a text; None if it has no tokens."""
    t = Tokenizer.from_file(queries.VOCABULARY)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    letters = trie_bpe.byte_letters()

    def align(text):
        if not text:
            return None
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = Counter((a[i], b[j]) for i, j in dict.fromkeys(zip(owner_a, owner_b)))
        groups, first = [], 0
        for k in range(len(owner_a)):
            if k + 1 == len(owner_a) or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1]):
                ids = [",".join(str(x[m]) for m in dict.fromkeys(owner[first : k + 1])) for x, owner in ((a, owner_a), (b, owner_b))]
                groups.append("|".join(ids))
                first = k + 1
        return len(a), len(b), ";".join(groups), links

    return align


@pytest.mark.parametrize("size", [1, 3, 11, None])
def test_fragments_compose_in_any_order(plain, size):
    a, b = alignment.tokenizers(queries.VOCABULARY, queries.PATTERN, queries.PIECES)
    r = random.Random(size)
    for text in ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 50))) for _ in range(60)] + ["a\u2581b", " ", "   ", "x" * 300, "a" * 20 + " " * 30 + "b"]:
        both = [alignment.streams(a, b, *x) for x in alignment.ranges(text, size or len(text) + 1)]
        want = plain(text)
        assert (None in both) == (want is None)
        if want:
            parts = [alignment.fragment(*x) for x in both]
            while len(parts) > 1:
                k = r.randrange(len(parts) - 1)
                parts[k : k + 2] = [alignment.compose(*parts[k : k + 2])]
            n, groups, (pairs, counts) = alignment.finish(parts[0])
            assert (groups, n) == (want[2], want[2].count(";") + 1)
            assert {(p >> 32, p & 0xFFFFFFFF): c for p, c in zip(pairs.tolist(), counts.tolist())} == want[3]
            assert alignment.finish(alignment.compose(alignment.EMPTY, alignment.compose(parts[0], alignment.EMPTY)))[1] == groups


def corpus(rows, plain):
    """The rows of correspond() for (doc_id, text)."""
    made = [(i, plain(t)) for i, t in rows]
    total = functools.reduce(Counter.__add__, (m[3] for _, m in made if m), Counter())
    highest = {}
    for (_, b), n in total.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for i, m in made:
        if not m:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = m
        best = sum(n for p, n in links.items() if total[p] == highest[p[1]])
        out.append((i, n_a, n_b, groups.count(";") + 1, sum(links.values()), best, sum(n * total[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    assert sorted(df.columns) == sorted(COLUMNS) and all(t == "bigint" for c, t in df.dtypes if c != "groups_sha256")
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table(spark, data, plain):
    docs = common.table(spark, data, "documents")
    want = sorted(corpus([(r.doc_id, r.text) for r in docs.collect()], plain), key=repr)
    assert rows_of(queries.queries()["op12_alignment"](spark, data)) == want


def test_cut_texts_and_blocks_of_pairs(spark, odd, none, plain):  # noqa: F811
    """Ranges of 2000 characters, trees of three, blocks of 300 pairs; nulls, repeated rows, an empty table; columns with inner names."""
    docs = odd.where("length(text) < 100000 or text is null").withColumn("pairs", F.lit(1)).withColumn("row", F.lit("x"))
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit((1 << 62) + 1), "text": F.repeat(F.lit("the tokens of\n  a longer text, "), 900)}))
    want = sorted(corpus([(r.doc_id, r.text) for r in docs.collect()], plain), key=repr)
    assert rows_of(alignment.correspond(docs, queries.VOCABULARY, queries.PATTERN, queries.PIECES, size=2000, fan=3, block=300)) == want
    assert rows_of(alignment.correspond(none, queries.VOCABULARY, queries.PATTERN, queries.PIECES)) == []
