"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked list of symbols, and decoding.

The queue holds (rank, place) of neighbouring symbols that can merge; an entry whose symbols have changed since is
stale and skipped. Decoding concatenates vocabulary strings. Distinct words are encoded once for each Python worker.
"""

from __future__ import annotations

import functools
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_level import Memo, Words, is_byte_level, read_vocabulary
from .common import python_batches, quoted, table, unused

VOCABULARY = "byte_bpe_50k.json"
_PLACE = (1 << 32) - 1


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        spec = read_vocabulary(path)
        if not is_byte_level(spec):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.byte_ids = [vocab[c] for c in chars]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = len(vocab) + len(spec["added_tokens"]) + 1
        self.rank = {vocab[a] * self.width + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        byte_of = {c: b for b, c in enumerate(chars)}
        self.pieces: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.words = Words(spec)
        for content, i in self.words.special.items():
            self.pieces[i] = content.encode()
        self.known = Memo(self.word)

    def word(self, word: str) -> bytes:
        """The ids of one word, packed as little-endian unsigned 32-bit integers."""
        if word in self.words.special:
            return self.words.special[word].to_bytes(4, "little")
        ids = [self.byte_ids[b] for b in word.encode()]
        n, rank, width, merged = len(ids), self.rank, self.width, self.merged
        if n > 1:
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(ids[i] * width + ids[i + 1])) is not None]
            heapify(queue)
            while queue:
                entry = heappop(queue)
                i, r = entry & _PLACE, entry >> 32
                j = after[i]
                if ids[i] < 0 or j == n or rank.get(ids[i] * width + ids[j]) != r:
                    continue  # stale
                ids[i], ids[j] = merged[r], -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := rank.get(ids[i] * width + ids[k])) is not None:
                        heappush(queue, r << 32 | i)
                h = before[i]
                if h >= 0 and (r := rank.get(ids[h] * width + ids[i])) is not None:
                    heappush(queue, r << 32 | h)
            ids = [x for x in ids if x >= 0]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words(text or "")))

    def decode(self, packed: bytes) -> str:
        """Vocabulary strings in a row; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One for each Python worker and vocabulary."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text as binary (little-endian, 4 bytes each); null counts as empty, an empty
    table gives none. A column `out` is replaced, all others pass through. No shuffle."""
    python_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        coder = bpe(path)
        return pd.Series([coder.encode(t) for t in texts], dtype=object)

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids; null ids give the empty text, an empty table none. A column `out` is replaced. No shuffle."""
    python_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        coder = bpe(path)
        return pd.Series([coder.decode(p or b"") for p in packed], dtype=object)

    return docs.withColumn(out, text(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: both directions in one pass, only digests leave the task.

    Null counts as empty, texts of any length are read whole, equal texts get equal results, an empty table gives none.
    Columns of docs with these names are replaced, all others pass through.
    """
    python_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_tokens long, ids_sha256 string, decoded_sha256 string>")
    def digests(texts: pd.Series) -> pd.DataFrame:
        coder, rows = bpe(path), []
        for t in texts:
            packed = coder.encode(t)
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(coder.decode(packed).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    names, (found,) = quoted([c for c in docs.columns if c.lower() not in new]), unused(docs, "found")
    return docs.select(*names, digests(F.col(text_col)).alias(found)).select(*names, *[F.col(f"{found}.{c}") for c in new])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: digests of every document's ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
