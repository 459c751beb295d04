"""Toxicity, quality, mixing, chat and WARC."""

import hashlib
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import chat, mixing, quality_classifier, quality_rules, toxicity, warc
from tracewarden.llm.common import table

BIG = "/root/testdata/sf0.01"


# Toxicity


def test_grammar_weighs_context():
    match = toxicity.Matcher(toxicity.Model({"idiot": 3.0}))
    score = lambda t: match.clause(t.split())
    assert score("you idiot") > score("an idiot") > score("she said an idiot") > score("never an idiot") > 0
    assert score("idiot like you") > score("an idiot") and score("kill you") > 0 and score("a plain clause") == 0
    assert score("not one of the many idiot") == score("one of the many idiot")


def test_composition_equals_running_one_after_the_other():
    first, second = toxicity.window("N", 2, "I", 0.5), toxicity.aimed()
    both = toxicity.compose(first, second)
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = b = c = 0
        for x in rng.choice(list(toxicity.SYMBOLS), 12):
            a, y, f = first[a, x]
            b, z, g = second[b, y]
            c, out, h = both[c, x]
            assert (out, h) == (z, f * g)


def test_reported_speech_goes_on_behind_a_colon():
    match = toxicity.Matcher(toxicity.Model({"idiot": 3.0}))
    assert list(match.clauses("she said: you idiot. a: b; c")) == [["she", "said", "you", "idiot"], ["a"], ["b"], ["c"]]
    assert match.features("she said: you idiot")[1] < match.features("see here: you idiot")[1]


def test_many_colons_take_linear_time():
    """Behind a report, a colon ends nothing, so that a clause may be as long as the text."""
    match = toxicity.Matcher(toxicity.Model({"idiot": 3.0}))
    began = time.perf_counter()
    assert match.features("idiot said " + ":a" * 500_000)[0] == 1.0
    assert [len(c) for c in match.clauses("said" + ":a" * 500_000)] == [500_001]
    assert sum(1 for _ in match.clauses("a" + ":a" * 500_000)) == 500_001
    assert time.perf_counter() - began < 20



def one_by_one(words, weight):
    """A clause's score by the three transducers, each run over the whole output of the one before."""
    match = toxicity.Matcher(toxicity.Model({}))
    symbols = [match.symbol.get(w, toxicity.INSULT if w in weight else toxicity.OTHER) for w in words]
    factors = [1.0] * len(words)
    for machine in (toxicity.window(toxicity.NEGATION, 3, "IH", 0.2), toxicity.window(toxicity.REPORT, 0, "IH", 0.5), toxicity.aimed()):
        state, out = 0, []
        for k, x in enumerate(symbols):
            state, y, f = machine[state, x]
            out.append(y)
            factors[k] *= f
        symbols = out
    worth = lambda w: 3.0 if match.symbol.get(w) == toxicity.THREAT else weight.get(w, 1.0)
    return min(10.0, sum(worth(w) * f for w, f, x in zip(words, factors, symbols, strict=True) if x in "IHD"))


def test_texts_score_as_by_brute_force():
    weight = {"idiot": 3.0, "fool": 2.5}
    match, rng = toxicity.Matcher(toxicity.Model(weight)), np.random.default_rng(5)
    words = "idiot fool kill you not said tree the of and he never".split()
    for _ in range(200):
        clauses = [list(rng.choice(words, rng.integers(1, 9))) for _ in range(rng.integers(1, 6))]
        scores = [one_by_one(c, weight) for c in clauses]
        got = match.features(". ".join(" ".join(c) for c in clauses))
        assert got[1] == pytest.approx(np.log1p(sum(scores))) and got[4] == pytest.approx(np.log1p(100 * sum(scores) / len(clauses)))
        assert got[2] == pytest.approx(max(scores) / 10)


def test_toxicity_held_out(spark):
    got = toxicity.query(spark, BIG).join(table(spark, BIG, "labels"), "doc_id").filter("held_out AND toxic IS NOT NULL").toPandas()
    assert got["score"].between(0, 1).all()
    assert got["predicted"][got["toxic"] == 1].mean() >= 0.8 and got["toxic"][got["predicted"] == 1].mean() >= 0.95


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    clash = odd.withColumns({"score": F.lit("mine"), "__scored": F.lit("kept"), "N_HITS": F.lit(1), "a.b": F.lit(2)})
    assert toxicity.score(clash, toxicity.Model({})).filter("__scored = 'kept' AND `a.b` = 2").count() == odd.count()
    got = toxicity.score(odd.withColumn("score", F.lit("mine")), toxicity.learn(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] < toxicity.REJECT for r in got)
    assert toxicity.score(odd.limit(0), toxicity.Model({})).count() == 0


# Quality


def test_gradients_are_those_of_the_loss():
    """Of a batch: one long text, one of a single half chunk, an empty one."""
    net, texts, y = quality_classifier.fresh(3), ["some bytes " * 40, "short", ""], np.array([1.0, 0.0, 1.0])
    data, weight = [quality_classifier.as_bytes(t) for t in texts], np.array([1.0, 2.0, 0.5])
    grads, p = quality_classifier.gradients(net, data, y, weight)
    chance = lambda: np.array([quality_classifier.probability(net, t) for t in texts])
    assert p == pytest.approx(chance(), abs=1e-5)
    loss = lambda: -(weight * np.log(np.where(y == 1, chance(), 1 - chance()))).sum()
    rng = np.random.default_rng(0)
    for p, g in zip(net.params(), grads, strict=True):
        for i in rng.choice(p.size, min(8, p.size), replace=False) if p is not net.filters else np.argsort(-np.abs(g.ravel()))[:8]:
            old, step = p.flat[i], 2e-3
            p.flat[i] = old + step
            high = loss()
            p.flat[i] = old - step
            low = loss()
            p.flat[i] = old
            assert abs((high - low) / (2 * step) - g.flat[i]) < 0.03 + 0.1 * abs(g.flat[i])


def naive_probability(net, text):
    """The forward pass by loops over bytes, chunks and units."""
    q = quality_classifier
    raw = text.encode()
    raw += b"\0" * (max(1, -(-len(raw) // q.HOP)) * q.HOP - len(raw))
    at = lambda i: raw[i] if i < len(raw) else 0
    acts = [[max(0.0, net.bias[f] + sum(net.filters[j, at(i + j), f] for j in range(q.WIDTH))) for f in range(q.FILTERS)] for i in range(len(raw))]
    places = [range(b, b + 2 * q.HOP) for b in range(0, len(raw) - q.HOP, q.HOP)] or [range(q.HOP)]
    units = [0.0] * q.HIDDEN
    for span in places:
        pooled = [max(acts[i][f] for i in span) for f in range(q.FILTERS)] + [sum(acts[i][f] for i in span) / len(span) for f in range(q.FILTERS)]
        for u in range(q.HIDDEN):
            units[u] = max(units[u], net.hidden_bias[u] + sum(x * net.hidden[k, u] for k, x in enumerate(pooled)))
    return 1 / (1 + np.exp(-(net.out_bias[0] + sum(x * w for x, w in zip(units, net.out, strict=True)))))


@pytest.mark.parametrize("text", ["", "é", "one half chunk", "several half chunks " * 30])
def test_score_is_that_of_a_naive_forward_pass(text):
    net = quality_classifier.fresh(5)
    assert quality_classifier.probability(net, text) == pytest.approx(naive_probability(net, text), abs=1e-4)


def test_blocks_do_not_change_the_score(monkeypatch):
    net, text = quality_classifier.fresh(), "a long text é " * 700
    whole = quality_classifier.probability(net, text)
    monkeypatch.setattr(quality_classifier, "BLOCK", quality_classifier.HOP * 3)
    assert quality_classifier.probability(net, text) == pytest.approx(whole, abs=1e-6)


def test_quality_held_out(spark):
    got = quality_classifier.query(spark, BIG).join(table(spark, BIG, "labels"), "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    assert got["predicted"][got["quality"] == 1].mean() >= 0.95 and (1 - got["predicted"][got["quality"] == 0]).mean() >= 0.8


def test_quality_odd_rows(spark, odd):
    net = quality_classifier.learn(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality_classifier.score(odd, net).collect()] == [0.5] * odd.count()


def test_rules_odd_rows(odd):
    got = quality_rules.quality_rules(odd.withColumn("kept", F.lit("mine"))).collect()
    assert len(got) == odd.count() and all(r["base_failed"] and not r["kept"] for r in got)
    assert {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0} and quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_rules_remove_lines_and_documents(make):
    prose = "\n".join(" ".join(f"word{chr(97 + i)}{j}" for j in range(9)) + "." for i in range(12))
    menu = "home | about | contact | help | more\n" * 30
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(make([prose, prose + "\n" + "All rights reserved", prose + "\n" + menu])).collect()}
    assert got[0]["kept"] and got[0]["n_lines_removed"] == 0
    assert got[1]["kept"] and got[1]["n_lines_removed"] == 1 and "reserved" not in got[1]["cleaned_text"]
    assert not got[2]["kept"] and got[2]["n_dup_lines"] == 29


def test_rules_take_very_long_words(make):
    texts = ["x" * 400_000, " ".join(["x" * 50_000] * 8), "  " + "a " * 8, "  " + "a " * 7]
    got = {r["doc_id"]: r["n_lines_removed"] for r in quality_rules.quality_rules(make(texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0}


# Mixing


def brute_targets(sizes):
    """Share out by weight; what is above a cap is shared again among the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, done, todo = 1.5 * sum(sizes.values()), {}, set(order)
    while todo:
        total = sum(weight[s] for s in todo)
        over = {s for s in todo if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return done | {s: left * weight[s] / total for s in todo}
        done |= {s: 2.0 * sizes[s] for s in over}
        left, todo = left - sum(2 * sizes[s] for s in over), todo - over
    return done


def test_mixing(spark, make):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["a", "b", "c", None, "hot", "hot", "hot", "hot"][i % 8]) for i in range(3000)]
    docs = make(rows)
    one = mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    two = mixing.mix(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert one.equals(two) and len(one) == 3000
    by = one.assign(source=one["source"].where(one["source"].notna(), "~")).groupby("source")
    want = brute_targets({None if k == "~" else k: int(v) for k, v in by["size"].sum().items()})
    for k, g in by:
        target = want[None if k == "~" else k]
        assert g["target"].iloc[0] == pytest.approx(target) and abs(g["taken"].sum() - target) <= 60
        assert (g["taken"] <= 2 * g["size"]).all() and g["taken"].nunique() > 1
        # Whatever a document's ratio, it gets the whole number below or above it.
        r = target / g["source_size"].iloc[0]
        assert g["copies"].between(np.floor(r), np.ceil(r)).all()


def test_pivot_is_unbiased_and_keeps_words():
    sizes, share = np.array([5.0, 3, 8, 1, 4, 6]), np.array([0.3, 0.7, 0.5, 0.2, 0.9, 0.4])
    total = np.zeros(6)
    for seed in range(4000):
        s = share.copy()
        held = mixing.pivot(sizes, s, np.random.default_rng(seed))
        assert s @ sizes == pytest.approx(share @ sizes) and sum(0 < x < 1 for x in s) == (held is not None)
        total += s
    assert np.abs(total / 4000 - share).max() < 0.03


def test_pool_is_unbiased_and_leaves_a_small_one():
    rng = np.random.default_rng(0)
    sizes, total = np.sort(np.ceil(np.exp(rng.normal(4, 1, 300))))[::-1], np.zeros(300)
    for seed in range(3000):
        share, held = mixing.pool(sizes, 0.4, np.random.default_rng(seed))
        assert share @ sizes == pytest.approx(0.4 * sizes.sum()) and (held is None or sizes[held] <= 0.005 * sizes.sum())
        total += share
    assert np.abs(total / 3000 - 0.4).max() < 0.05


@pytest.mark.parametrize("n", [5, 50, 500])
def test_pool_makes_good_for_one_very_long_document(n):
    """Whole targets with a document of twice the words of all others, for ten seeds: within 1 %, of five within a short document."""
    for seed in range(10):
        rng = np.random.default_rng(seed)
        sizes = np.sort(np.append(rng.integers(20, 300, n - 1), 320 * (n - 1)).astype(float))[::-1]
        share = float(rng.uniform(0.02, 0.3))
        got, held = mixing.pool(sizes, share, rng)
        if held is not None:
            got[held] = round(got[held])
        assert abs(got @ sizes - share * sizes.sum()) <= (sizes[1] if n == 5 else 0.01 * sizes.sum()) and set(got) <= {0.0, 1.0}


def test_every_source_meets_its_target(spark):
    """Sources of about fifty documents, some with one of very many words."""
    rows = mixing.query(spark, BIG).toPandas().merge(table(spark, BIG, "documents").select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in rows.groupby("source"):
        assert abs(g["taken"].sum() / g["target"].iloc[0] - 1) < 0.01


def test_mixing_odd_rows(odd):
    clash = odd.withColumns({"size": F.lit("mine"), "__row": F.lit(1), "__key": F.lit(2), "Target": F.lit(3), "ratio": F.lit(4), "a.b": F.lit(5)})
    assert mixing.mix(clash).filter("__row = 1 AND ratio = 4 AND `a.b` = 5").count() == odd.count()
    got = mixing.mix(odd.withColumn("size", F.lit("mine"))).collect()
    assert len(got) == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert all(r["copies"] == 1 and r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["taken"] <= 2 * r["size"] for r in got)


# Chat


def test_mixing_counts_words_without_listing_them(make, odd):
    """No list of a text's words is made, and each row's words are counted after its branch is chosen."""
    docs = odd.unionByName(make([(20, "\ta\x0bb\x0cc\rd\n", "a"), (21, "\u00a0\u2003 \x1f \x85", "b"), (22, "$1 \\\\ x" * 9, None)]))
    for r in mixing.mix(docs).collect():
        assert r["size"] == len((r["text"] or "").encode().split())
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "extract_all" not in plan and plan.count("regexp_replace") == 2


def test_escape_is_reversible_and_hides_control_strings():
    for t in ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<<s>", "<\\/s>", "<|im_end|>\n", "[[INST]]", "é\\[/INST]\\\\", "<<SYS>>x<</SYS>>"]:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        assert chat.parse(chat.render([(t, t), ("assistant", t)])[0]) == [(t, t), ("assistant", t)]


def test_layouts_find_their_mapping(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "", "output": "o"}, {"data": {"question": "q", "answer": None}},
        {"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]},
        {"messages": []}, {"other": 1}, [1], None,
    ]
    rows = [(i, None if r is None else json.dumps(r)) for i, r in enumerate(records)] + [(99, "{broken")]
    got = {r["id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "id int, record string"))).collect()}
    assert [got[i]["layout"] for i in range(7)] == ["prompt", "instruction", "instruction", "question", "messages", "conversations", "messages"]
    assert [got[i]["n_turns"] for i in range(7)] == [2, 2, 2, 2, 2, 2, 0] and got[7]["layout"] is None and got[7]["fingerprint"]
    assert all(got[i]["formatted"] is None and got[i]["n_turns"] == 0 for i in (7, 8, 9, 99)) and got[99]["fingerprint"] is None
    assert chat.parse(got[1]["formatted"]) == [("system", "i"), ("assistant", "o")]


def test_conversations_read_back(spark):
    rows = [(1, 2, "assistant", "b\\"), (1, 1, "user", None), (2, 1, "user", chat.HOSTILE), (2, 1, "user", "tie"), (3, None, None, "lone"), (None, 1, "user", "x"), (None, 1, "user", "y"), (4, 1, "human", "h")]
    got = chat.read_back(chat.format_chats(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    by = {r["conv_id"]: r for r in got if r["conv_id"] is not None}
    assert by[1]["turns_sha256"] == sha(("user", ""), ("assistant", "b\\")) and by[1]["loss_chars"] == 2
    assert by[2]["turns_sha256"] == sha(("user", chat.HOSTILE), ("user", "tie")) and by[4]["turns_sha256"] == sha(("human", "h"))
    assert by[3]["turns_sha256"] == sha(("", "lone")) and sum(r["conv_id"] is None for r in got) == 2


# WARC


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    same, small, long = "p" * 150 + "\r\n\r\nWARC/1.1\r\n", "tiny", "long é " * 80_000
    rows = [(5, "http://a/\r\nX: y", same), (2, None, same), (2, "u", same), (9, "u", same), (3, "u", small), (4, "u", small), (6, "u", None), (None, "u", same), (7, "u", "é日" * 60), (8, "v", long), (10, "w", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    extra = pages.withColumns({"record_type": F.lit(1), "__original": F.lit(2), "__row": F.lit(3), "Payload_Digest": F.lit(4)})
    resolved = warc.resolve(extra)
    assert resolved.filter("__original = 2 AND __row = 3").count() == len(rows)
    warc.write(warc.as_records(resolved), path, file_bytes=1 << 16)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (5, 9, None)) == [(0, "revisit", 2), (5, "revisit", 2), (9, "revisit", 2)]
    payloads = {3: small, 4: small, 6: "", 7: "é日" * 60, 8: long, 10: long}
    for r in got:
        want = payloads.get(r["page_id"], same)
        if r["record_type"] == "response":
            assert r["payload"] == want and r["payload_digest"] == hashlib.sha256(want.encode()).hexdigest() and r["refers_to"] is None
        assert r["payload_bytes"] == len(want.encode())
    assert [r["url"] for r in got if r["page_id"] == 5] == ["http://a/%0D%0AX:%20y"]
    # Every record has an id of its own, and what a revisit refers to is there.
    headers = [h for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect() for h, _ in warc.parse(bytes(f["content"]))]
    ids = [h["WARC-Record-ID"] for h in headers]
    assert len(set(ids)) == len(rows) and all(h["WARC-Refers-To"] in ids and h["WARC-Refers-To-Date"] for h in headers if h["WARC-Type"] == "revisit")
    assert max(sum(1 for _ in warc.parse(bytes(f["content"]))) for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()) <= 2
    assert warc.classes_present(pages) == [0, 2]
    with pytest.raises(ValueError, match="WARC record"):
        list(warc.parse(b"junk\r\n\r\nmore"))
    warc.write(warc.as_records(warc.resolve(pages.limit(0))), f"{path}-none")
    assert warc.read(spark, f"{path}-none").count() == 0


def test_rules_take_long_runs_of_capitals_and_symbols_in_linear_time(make):
    """A million characters of each kind: capitals alone, in words, with stops between, and what the other rules look at."""
    kinds = ["A", "AB", "A B", "A, ", "AB CD ", "AB  x", "!", "!! ", "#", "## ", "|", " ", "a"]
    texts = [(k * 1_000_000)[:1_000_000] for k in kinds]
    began = time.perf_counter()
    got = {kinds[r["doc_id"]]: r["n_lines_removed"] for r in quality_rules.quality_rules(make(texts)).select("doc_id", "n_lines_removed").collect()}
    assert time.perf_counter() - began < 60
    assert got["AB CD "] == got["AB  x"] == got["A B"] == 1 and got["A"] == got["AB"] == got["A, "] == 0
