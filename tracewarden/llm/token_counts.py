"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both agree.

A chunk is encoded with the offsets of its words. Two neighbours are spliced at a boundary that both have and that is
proven stable: between a non-space and a white-space character. No word of the byte-level pattern, nor any special
string, holds a white-space character after another kind of character, so every encoding has a boundary there, what
comes before is encoded without regard to what follows, and the other way round. Where the overlap holds no such
place, it is widened, in the end to the whole text. So the count is the one that the library gives for the whole text.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_level import Memo, Words, is_byte_level, read_vocabulary
from .common import python_batches, table

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 15, 256
LIMIT = 1024
SPACES = " \t\n\r\x0b\x0c"


class Counter:
    """Counts by the vocabulary's own library. Words of a byte-level vocabulary are encoded once and remembered."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.chunk, self.overlap, self.words = chunk, overlap, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(model.encode(text, num_threads=1))
            return
        from tokenizers import Tokenizer

        model, spec = Tokenizer.from_file(path), read_vocabulary(path)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda text: len(model.encode(text, add_special_tokens=False).ids)
        if is_byte_level(spec):
            self.words, self.known = Words(spec), Memo(self.whole)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins and how many tokens it has."""
        words = self.words(text)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return np.cumsum(lengths) - lengths, np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str | None) -> int:
        text = text or ""
        if self.words is None:
            return self.whole(text)
        if len(text) <= self.chunk:
            return sum(map(self.known.__getitem__, self.words(text)))
        return self.spliced(text)

    def spliced(self, text: str) -> int:
        total, begin, size = 0, 0, self.chunk
        starts, counts = self.encode(text[:size])
        end = min(size, len(text))
        while end < len(text):
            overlap, cut = self.overlap, None
            while cut is None:
                low = max(begin, end - overlap)
                after = min(low + max(self.chunk, 2 * overlap), len(text))
                more, more_counts = self.encode(text[low:after])
                more = more + low
                common = np.intersect1d(starts, more, assume_unique=True)
                cut = next((p for p in common[::-1].tolist() if begin < p < end and text[p] in SPACES and text[p - 1] not in SPACES), None)
                if cut is None and low == begin:
                    # No stable place in the whole chunk: it grows instead.
                    cut, more, more_counts = begin, *self.encode(text[begin:after])
                    more = more + begin
                overlap *= 2
            total += int(counts[starts < cut].sum())
            starts, counts, begin, end = more[more >= cut], more_counts[more >= cut], cut, after
        return total + int(counts.sum())


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each Python worker and vocabulary, so that what it remembers serves all its tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text, without added tokens, truncation or padding; no shuffle.

    path: a vocabulary file that every executor has (.json or .model). Null counts as empty, equal texts get equal
    counts, an empty table gives none. A column `out` is replaced, all others pass through.
    """
    python_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        count = counter(path)
        return pd.Series([count(t) for t in texts], dtype="int64")

    return docs.withColumn(out, tokens(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    out = count_tokens(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
