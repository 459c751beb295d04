"""Fill-in-middle, lexical search and SimHash against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewarden.llm import common, fill_in_middle, lexical_search, simhash

from test_copies import brute_components, words

# Ropes


def check_heights(node):
    if node and node.left:
        check_heights(node.left)
        check_heights(node.right)
        assert abs(node.left.height - node.right.height) <= 1
        assert (node.units, node.chars) == (node.left.units + node.right.units, node.left.chars + node.right.chars)
    elif node:
        assert node.chars == len(node.text)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_ropes_split_and_join_at_any_rank(monkeypatch, unit):
    monkeypatch.setattr(fill_in_middle, "LEAF", 5)
    rng, pattern = random.Random(4), fill_in_middle.UNITS[unit]
    for size in (0, 1, 4, 5, 6, 40, 300):
        text = "".join(rng.choice("ab é日𝒳 \n") for _ in range(size))
        tree = fill_in_middle.rope(text, pattern)
        ends = range(1, size + 1) if pattern is None else fill_in_middle._ends(text, pattern)
        units = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert str(tree) == text and (tree.units, tree.chars) == (len(units), len(text))
        for rank in range(len(units) + 2):
            left, right = fill_in_middle.split(tree, rank, "units", pattern)
            check_heights(left)
            check_heights(right)
            assert (str(left or ""), str(right or "")) == ("".join(units[:rank]), "".join(units[rank:]))
            assert ((left.units if left else 0), (right.units if right else 0)) == (len(units[:rank]), len(units[rank:]))
            back = fill_in_middle.join(right, left)
            check_heights(back)
            assert str(back or "") == "".join(units[rank:] + units[:rank])
        for at in range(len(text) + 1):
            left, right = fill_in_middle.split(tree, at, "chars", pattern)
            assert (str(left or ""), str(right or "")) == (text[:at], text[at:])


def brute_fim(doc_id, text):
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_fill_in_middle_and_back(make, odd):
    rng = random.Random(6)
    texts = [None, "", "a", "<P", "<S<", "x <M> y", "𝒳é" * 5000] + ["".join(rng.choice("<PSM> aé𝒳\n") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(make(texts))).collect()
    for r in made:
        text = texts[r["doc_id"]] or ""
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fim(r["doc_id"], text)
        assert r["restored"] == text
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    for unit in fill_in_middle.UNITS:
        got = fill_in_middle.restore(fill_in_middle.fill_in_middle(odd.withColumn("N", F.lit(1)).withColumn("__made", F.lit(7)), unit=unit, rate=100)).collect()
        assert len(got) == odd.count() and all(r["restored"] == (r["text"] or "") and r["__made"] == 7 for r in got)
        assert all((r["form"] == "plain") == (not r["text"]) for r in got)
    by_word = fill_in_middle.fill_in_middle(make([" one two\nthree  "]), unit="word", rate=100).first()
    assert by_word["n"] == 3
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(odd.limit(0))).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(odd, unit="page")


# Search


def brute_search(docs, items, k):
    found = lambda t: re.findall(lexical_search.TERM, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(i, Counter(found(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms, df, out = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c), []
    queries = {}
    for item, text in items:
        queries.setdefault(item, []).extend(found(text))
    for item, asked in queries.items():
        scored = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("shard", [4096, 7])
def test_search_against_brute_force(spark, make, monkeypatch, shard):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    rng = random.Random(9)
    vocabulary = ["Alpha", "beta", "naïve", "日本", "x1", "the", "of", "…", "rare", "zz"]
    texts = [" ".join(rng.choices(vocabulary, [5, 5, 3, 2, 4, 30, 20, 2, 1, 1], k=rng.randrange(0, 25))) for _ in range(150)]
    docs = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[4], "s"), (500, None, "s"), (501, "--!", "s"), (502, "the " * 30_000 + "rare", "s")]
    items = [(1, "ALPHA beta the beta"), (2, "rare;zz"), (3, None), (4, ""), (5, "nowhere"), (6, "the"), (6, "日本"), (None, "x1 of")]
    queries = spark.createDataFrame(items, "item_id int, text string")
    index = lexical_search.build_index(make(docs).repartition(3))
    for k, block in ((10, 1000), (3, 2), (400, 1)):
        got = sorted(map(tuple, lexical_search.search(index, queries, k, block=block).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == sorted(brute_search([(i, t) for i, t, _ in docs], items, k), key=str)


def test_search_of_and_in_empty_tables(spark, odd):
    queries = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for docs in (odd, odd.limit(0)):
        index = lexical_search.build_index(docs)
        assert lexical_search.search(index, queries.limit(0)).count() == 0
        assert lexical_search.search(index, queries).count() == (3 if docs is odd else 0)


def test_best_keeps_the_right_ties():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        scores, ids, nameless = rng.integers(0, 4, n), rng.integers(0, 9, n), rng.random(n) < 0.2
        want = sorted((-s, no, i) for s, no, i in zip(scores.tolist(), nameless.tolist(), ids.tolist(), strict=True) if s > 0)[:5]
        at = lexical_search.best(scores, nameless, ids, 5)
        assert [(-s, no, i) for s, no, i in zip(scores[at].tolist(), nameless[at].tolist(), ids[at].tolist(), strict=True)] == want


# SimHash


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(make):
    rng = random.Random(8)
    texts = ["", None, " \t", "a", "A b", "a b c d", "a b c d e", "x\xa0y É é", "q " * 20_000] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    got = {r["id"]: r["fp"] for r in simhash.fingerprints(make(texts)).collect()}
    assert [got[i] % (1 << 64) for i in range(len(texts))] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_slices_count_like_one_by_one(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1)
    for k in range(1, 300, 2):  # near ones at every distance up to 9
        fps[k] = fps[k - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 10, replace=False)))
    low, high = np.arange(300) + 1, np.full(300, 300)
    far = np.array([[bin(int(a ^ b)).count("1") for b in fps] for a in fps])
    edges = [(a, b) for a in range(300) for b in range(a) if far[a, b] <= radius]
    want = brute_components(range(300), edges)
    assert simhash.grouped(fps, low, high, radius).tolist() == [want[k] for k in range(300)]
    planes, units = simhash.planes_of(fps), np.repeat(np.arange(300), 5)
    found = simhash.within(planes, fps[units], np.tile(np.arange(5), 300), np.full(1500, simhash._ONES), radius)
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(300, 320)[:, :300]
    assert (bits == (far <= radius)).all()


@pytest.mark.parametrize("pieces", [5, 6, 7])
def test_links_of_wide_and_narrow_buckets(spark, monkeypatch, pieces):
    """Chains, dense balls in buckets of many blocks, and pairs at the radius, whose differing bits lie anywhere."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(common, "HOT", 30)
    rng = random.Random(pieces)
    fps = set()
    for _ in range(40):
        fp = rng.getrandbits(64)
        fps.add(fp)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.choice([3, 4, 5])):
                fp ^= 1 << b
            fps.add(fp)
    centre = rng.getrandbits(64)
    for _ in range(250):
        fp = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 6])):
            fp ^= 1 << b
        fps.add(fp)
    low = rng.getrandbits(22)  # many share the first pieces and are unlike otherwise
    fps |= {rng.getrandbits(40) << 24 | low for _ in range(150)}
    fps = rng.sample(sorted(fps), len(fps))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    edges = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    got = [(r["a"], r["b"]) for r in simhash.links(nodes, 4, pieces).collect()]
    assert brute_components(range(len(fps)), got) == brute_components(range(len(fps)), edges)


def test_simhash_documents(make, odd):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = []
    for k in range(40):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(400)] = f"v{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"u{rng.randrange(900)}" for _ in range(100)) for _ in range(60)] + ["", None, " "]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(200, texts[60], "s"), (200, texts[70], "s"), (None, texts[0], "s")]
    got = simhash.near_duplicates(make(rows)).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    named = [(i, f) for i, f in prints if i is not None]
    edges = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[:k] if bin(x ^ y).count("1") <= 4]
    want = brute_components({i for i, _ in named}, edges)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got) == sorted((i is None, i or 0, f"{f:016x}", want.get(i)) for i, f in prints)
    assert want[200] == 60 and want[70] == 60 and want[102] == 100
    out = simhash.near_duplicates(odd)
    assert out.count() == odd.count() and all(r["kept"] for r in out.filter("doc_id IS NULL").collect())
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd, radius=6)
