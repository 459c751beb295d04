"""Token operators against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewarden.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a  <|endoftext|>b  c", "!!<|endoftext|>", "x" * 3000, "日本語 テスト x", "\t\n\r\x0b x  y\n\n z", "I'm you'll 123 4５6", "a\x00b é", "🎉🎉 ok"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def drawn(n):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", ".", ",", "\n", "\t", "'s", "é", "日", "1", "<|endoftext|>", "<|", "the", " and"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe_equals_library_and_round_trips(library):
    coder = bpe.Bpe(PATH)
    for t in TEXTS + drawn(500):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids
        assert coder.decode(coder.encode(t)) == library.decode(ids, skip_special_tokens=False) == t


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 1), (40, 3), (300, 2)])
def test_spliced_counts_equal_whole_counts(library, chunk, overlap):
    count = token_counts.Counter(PATH, chunk, overlap)
    for t in TEXTS + drawn(400):
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_other_vocabularies():
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert token_counts.Counter(public_tokenizers.path(name))("The quick brown fox") >= 4


def test_memo_is_bounded():
    memo = token_counts.Memo(len, most=3)
    assert [memo["x" * i] for i in (1, 2, 3, 4, 1, 2)] == [1, 2, 3, 4, 1, 2] and len(memo) <= 3
    assert memo["x" * 1000] == 1000 and "x" * 1000 not in memo and "x" * 1000 not in memo.old


def test_operators_on_odd_rows(odd, library):
    rows = odd.collect()
    n = {(r["doc_id"], r["text"]): len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows}
    got = bpe.round_trip(token_counts.count_tokens(odd, PATH, out="counted"), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["counted"] == r["n_tokens"] == n[r["doc_id"], r["text"]]
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, PATH), PATH).select("text", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe.round_trip(odd.limit(0), PATH).count() == token_counts.count_tokens(odd.limit(0), PATH).count() == 0
