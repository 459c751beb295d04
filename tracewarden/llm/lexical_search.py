"""Ranked lexical search over shards of postings.

Each task turns the documents that it reads into shards: a sorted vocabulary and, in compressed sparse rows by term, the
places of the documents that hold it with precomputed whole-number impacts. Documents are never dealt out. Queries run in
blocks of bounded size against all shards: term by term, impacts are added to one dense accumulator a shard, the best are
selected with all their ties, and the shards' best are merged, first inside a task, then over tasks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, lower_ascii, python_batches, quoted, table, written

#: A term: ASCII letters and digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents of a shard, and bytes of their texts from which a shard is full; a longer text has one of its own.
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: Items of a query block, about: blocks are dealt out by a hash.
ITEMS = 1000
#: Length normalisation in per cent, and the share of a term's occurrences, in thousandths, that length weighs against.
B, SATURATION = 75, 8
#: Parts in which candidates are cut before the last cut, so that one task holds few of an item's.
PARTS = 64

INDEX = "n_docs int, doc_ids binary, nameless binary, vocabulary binary, starts binary, places binary, impacts binary"


def terms(text: str | None) -> list[bytes]:
    """The text's terms in order, A-Z lower-cased, in UTF-8; all separators are ASCII, so bytes tell them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents hold a term, and how many terms all hold, with repeats."""
    n = F.coalesce(F.regexp_count(quoted([text_col])[0], F.lit(TERM)), F.lit(0)).cast("long")
    return tuple(docs.select(n.alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first())


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share of a score before its weight, in whole numbers below 1,000,000."""
    m = 100 - B + (B * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


def _shard(rows: list[tuple], n_docs: int, n_terms: int) -> tuple:
    """One row of the index from (id, terms) of its documents."""
    numbers = defaultdict()
    numbers.default_factory = numbers.__len__
    counts = [Counter(found) for _, found in rows]
    size = np.fromiter(map(len, counts), np.int64, len(rows))
    length = np.fromiter((len(found) for _, found in rows), np.int64, len(rows))
    total = int(size.sum())
    term = np.fromiter(map(numbers.__getitem__, chain.from_iterable(counts)), np.int64, total)
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, total)
    place = np.repeat(np.arange(len(rows)), size)
    names = list(numbers)
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    by_term = np.argsort(rank[term], kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(rank[term], minlength=len(names)))])
    made = impacts(tf, length[place], n_docs, n_terms)[by_term]
    ids = [i for i, _ in rows]
    return (
        len(rows), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids]).tobytes(), b" ".join(names[k] for k in order),
        starts.astype("<i4").tobytes(), place[by_term].astype("<u2").tobytes(), made.astype("<i4").tobytes(),
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents that hold a term, a row a shard, written to the shared folder.

    Whole texts of any length; null counts as empty. Repeated rows are documents of their own, those with a null id too:
    they count in all statistics and are found without an id. An empty table gives an empty index. Other columns of docs
    are not read, whatever their names. No shuffle.
    """
    python_batches(docs.sparkSession)
    n_docs, n_terms = statistics(docs, text_col)

    def run(batches):
        rows, size = [], 0
        for pdf in batches:
            for i, text, null in zip(pdf["id"].tolist(), pdf["text"], pdf["id"].isna(), strict=True):
                found = terms(text)
                if found:
                    rows.append((None if null else int(i), found))
                    size += len(text)
                if len(rows) == SHARD_DOCS or size >= SHARD_BYTES:
                    yield pd.DataFrame([_shard(rows, n_docs, n_terms)], columns=NAMES)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame([_shard(rows, n_docs, n_terms)], columns=NAMES)

    # Ids travel as text, since a column with nulls would come as floating point.
    read = docs.select(quoted([id_col])[0].cast("long").cast("string").alias("id"), quoted([text_col])[0].alias("text"))
    return written(read.mapInPandas(run, INDEX), "lexical-index")


NAMES = [f.split()[0] for f in INDEX.split(", ")]


def document_frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the wanted terms; only vocabularies and posting lengths are read."""

    def run(batches):
        sums = Counter()
        for pdf in batches:
            for words, starts in zip(pdf["vocabulary"], pdf["starts"], strict=True):
                lengths = np.diff(np.frombuffer(starts, "<i4"))
                for k, word in enumerate(words.split(b" ")):
                    if word in wanted:
                        sums[word] += int(lengths[k])
        yield pd.DataFrame({"term": list(sums), "n": list(sums.values())}, columns=["term", "n"])

    found = index.select("vocabulary", "starts").mapInPandas(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}


def best(scores: np.ndarray, nameless: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by ascending id, those without an id last.

    A partition finds the k-th highest score; all that reach it are sorted, so that no tie is cut at random.
    """
    least = 1
    if len(scores) > k:
        least = max(1, scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]])
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], nameless[some], -scores[some]))[:k]]


def _search(items: list[tuple], k: int):
    """items: (number, [(term, weight times occurrences)]). Yields each item's best of all shards that a task reads."""
    wanted = {t for _, parts in items for t, _ in parts}

    def run(batches):
        top: dict = {}
        for pdf in batches:
            for n, ids, nameless, words, starts, places, made in pdf[NAMES].itertuples(index=False):
                ids, nameless, starts = np.frombuffer(ids, "<i8"), np.frombuffer(nameless, bool), np.frombuffer(starts, "<i4")
                places, made = np.frombuffer(places, "<u2"), np.frombuffer(made, "<i4").astype(np.int64)
                at = {t: i for i, t in enumerate(words.split(b" ")) if t in wanted}
                scores = np.zeros(n, np.int64)
                for item, parts in items:
                    scores[:] = 0
                    for t, weight in parts:
                        if (p := at.get(t)) is not None:
                            here = slice(starts[p], starts[p + 1])
                            scores[places[here]] += weight * made[here]
                    chosen = best(scores, nameless, ids, k)
                    if len(chosen):
                        mine = (scores[chosen], nameless[chosen], ids[chosen])
                        if item in top:
                            mine = tuple(map(np.concatenate, zip(top[item], mine, strict=True)))
                            keep = best(*mine, k)
                            mine = tuple(x[keep] for x in mine)
                        top[item] = mine
        rows = [(item, None if no else str(i), s) for item, (ss, nn, ii) in top.items() for s, no, i in zip(ss.tolist(), nn.tolist(), ii.tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["number", "doc", "score"]).astype({"number": "int64", "score": "int64"})

    return run


def _blocks(queries: DataFrame, item_col: str, text_col: str, size: int):
    """Items with their different terms, block by block: (items by number, [(number, [(term, occurrences)])])."""
    every = queries.select(quoted([item_col])[0].alias("item"), F.explode(F.regexp_extract_all(lower_ascii(quoted([text_col])[0]), F.lit(TERM), F.lit(0))).alias("term"))
    every = every.groupBy("item", "term").agg(F.count(F.lit(1)).alias("q")).groupBy("item").agg(F.collect_list(F.struct("term", "q")).alias("terms"))
    every = written(every, "query-terms")
    many = -(-every.count() // size)
    for block in range(many):
        rows = every.filter(F.pmod(F.xxhash64("item"), F.lit(many)) == block).collect()
        yield [r["item"] for r in rows], [(k, [(t["term"].encode(), t["q"]) for t in r["terms"]]) for k, r in enumerate(rows)]
    drop(every)


def _cut(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block: int = ITEMS) -> DataFrame:
    """(item, rank, doc_id, score) of each item's k highest-scoring documents, from rank 1 on.

    A term weighs floor(1000 ln((2 n + 2) / (2 df + 1))), n being the index's documents and df those that hold it; a score sums weight
    times impact over the item's terms, repeats included. Equal scores go by ascending doc_id. Rows with the same item id
    (null is one) make one item, items without terms or without a document above 0 have no row. The driver holds one block
    of items at a time, their terms and what those weigh.
    """
    spark, out = index.sparkSession, None
    python_batches(spark)
    n_docs = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    kind = dict(queries.dtypes)[item_col]
    for names, items in _blocks(queries, item_col, text_col, block):
        df = document_frequencies(index, {t for _, parts in items for t, _ in parts})
        weight = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1)))) for t, n in df.items()}
        weighed = [(number, [(t, q * weight[t]) for t, q in parts if t in weight]) for number, parts in items]
        found = index.mapInPandas(_search(weighed, k), "number long, doc string, score long")
        named = spark.createDataFrame(list(enumerate(names)), f"number long, `{item_col}` {kind}")
        found = found.select("number", F.col("doc").cast("long").alias("doc_id"), "score", F.pmod(F.xxhash64("doc"), F.lit(PARTS)).alias("part"))
        found = _cut(_cut(found, ["number", "part"], k).drop("rank", "part"), ["number"], k)
        found = written(found.join(F.broadcast(named), "number").select(item_col, "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"`{item_col}` {kind}, rank int, doc_id long, score long") if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the ten best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(build_index(docs), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM documents),
d AS (SELECT *, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, d.r, d.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
