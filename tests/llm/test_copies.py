"""Exact and near duplicates, and components, against brute force."""

import random
import re

from pyspark.sql import functions as F

from tracewarden.llm import common, exact_dedup, near_dedup
from tracewarden.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact(spark, odd, make):
    out = {(r["doc_id"], r["text"], r["source"]): r for r in exact_dedup.exact_dedup(odd).collect()}
    assert odd.count() == exact_dedup.exact_dedup(odd).count()
    assert out[1, None, "a"]["keep_id"] == 2 and out[1, None, "a"]["group_size"] == 3 and out[2, "", "a"]["kept"]
    assert out[None, "one two three four five", None]["keep_id"] == 5 and not out[None, "one two three four five", None]["kept"]
    got = exact_dedup.exact_dedup(make(["Ab É", "aB É", "ab é", "x" * 70 + "1", "x" * 70 + "2"])).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    clash = odd.withColumn("kept", F.lit("mine")).withColumn("__other", F.lit(1))
    assert exact_dedup.exact_dedup(clash).filter("kept").count() > 0


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(20)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (3, 2), (None, 4)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, n):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    edges = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y)]
    return brute_components({i for i, _ in sets if i is not None}, edges)


def test_near_against_brute_force(spark, make, monkeypatch):
    """Chains of edits (neighbours link, ends do not), a shared passage, copies, and buckets of several blocks, wide ones too."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "STRIP", 3)
    monkeypatch.setattr(near_dedup, "WIDE", 12)
    monkeypatch.setattr(common, "HOT", 6)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(4):
        text = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(12):
            texts.append(" ".join(text))
            for _ in range(3):
                text[rng.randrange(150)] = rng.choice(vocabulary)
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(25)]) for _ in range(30)]
    texts += [texts[0].upper(), texts[0], "a b", "A  b", "a", "", None, " \n"]
    rng.shuffle(texts)
    for n in (4, 5):
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(make(texts), n).collect()}
        want = expected(list(enumerate(texts)), n)
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["kept"] == (want[i] == i) and r["n_shingles"] == len(shingle_set(texts[i], n)) for i, r in got.items())


def test_near_buckets_of_many_unlike_members(make, monkeypatch):
    """Thousands share a passage but are unlike (0.63 alike), so that buckets hold thousands; hundreds of pairs of them are
    just alike enough, and a template's copies link to it alone. Every link is found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 512)
    asked = []
    whole = near_dedup._Search.tiles
    monkeypatch.setattr(near_dedup._Search, "tiles", lambda self, rows: asked.append(rows.agg(F.max("n")).first()[0]) or whole(self, rows))
    rng = random.Random(11)
    own = lambda k, n: [f"{k}x{i}" for i in range(n)]
    passage = own("p", 120)
    texts = [" ".join(passage + own(k, 35)) for k in range(4000)]
    # The last 16 of the own words are others.
    pairs = [(10 * k, 4000 + k) for k in range(400)]
    texts += [" ".join(passage + own(a, 19) + own(f"o{a}", 16)) for a, _ in pairs]
    template = own("t", 120)
    for k in range(300):
        copy = list(template)
        for i in rng.sample(range(5, 115, 5), 3):
            copy[i] = f"{k}z{i}"
        texts.append(" ".join(copy))
    texts.append(" ".join(template))
    order = rng.sample(range(len(texts)), len(texts))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make([(i, texts[i], "s") for i in order])).collect()}
    sets = [shingle_set(t, 4) for t in texts]
    similarity = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    links = pairs + [(a, len(texts) - 1) for a in range(4400, 4700)]
    assert all(0.8 <= similarity(a, b) for a, b in links) and max(similarity(a, b) for a, b in pairs) < 0.83
    assert 0.6 < similarity(0, 1) < 0.7 and similarity(1, 4000) < 0.8 and len(texts) == 4701
    assert got == brute_components(range(len(texts)), links) and asked and asked[0] > 1000


def test_members_meet_their_components_once(spark, make, monkeypatch):
    """A member of a bucket is joined with its component once, and after second centres only where its bucket was open."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "WIDE", 12)
    made, given = spark.sparkContext.accumulator(0), []

    @F.udf("long")
    def counted(comp):
        made.add(1)
        return comp

    whole = near_dedup.with_components

    def watched(members, label):
        rows = whole(members, label)
        given.append((rows.count(), rows.select("bucket").distinct().count()))
        assert given[-1][0] <= members.count()
        return rows.withColumn("comp", counted("comp"))

    monkeypatch.setattr(near_dedup, "with_components", watched)
    own = lambda k, n: [f"{k}x{i}" for i in range(n)]
    # One group is unlike but for a passage, the other's texts are all nearly the same.
    texts = [" ".join(own("p", 120) + own(k, 35)) for k in range(60)] + [" ".join([*own("q", 150), f"z{k}"]) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make(texts)).collect()}
    assert got == expected(list(enumerate(texts)), 4)
    assert len(given) == 2 and given[1][0] < given[0][0] and given[1][1] < given[0][1]
    assert made.value == sum(n for n, _ in given)


def test_near_ids_with_several_texts(make):
    """An id that repeats with texts of two classes joins them, though it represents neither."""
    one, two = "a b c d e f g h", "i j k l m n o p"
    got = near_dedup.near_duplicates(make([(5, one, "s"), (6, two, "s"), (9, one, "s"), (9, two, "s"), (9, "", "s"), (4, "", "s")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(4, 4), (5, 5), (6, 5), (9, 5), (9, 5), (9, 5)]


def test_near_odd_rows(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["component_id"] for r in got if r["doc_id"] == 5} == {5}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_sketch_is_mergeable_and_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = near_dedup.sketch(pool[:2000]), near_dedup.sketch(pool[500:])
    assert (np.maximum(a, b) == near_dedup.sketch(pool)).all()
    one = np.array([1.0])
    est = near_dedup.likelihood(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([(a == b).sum()]), 2000 * one, 2500 * one)[0]
    assert abs(est - 1500 / 3000) < 0.2
