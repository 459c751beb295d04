"""Toxicity by a weighted grammar of composed finite-state transducers.

A lexical transducer maps words to symbols (insult, threat, target, negation, reported speech, other); the context
transducers below rewrite and weigh these symbols, and their composition is one small deterministic machine that runs
over the clauses holding an insult or a threat. Scores belong to matched clauses: an insult that is negated or merely
reported weighs less, one with a target in its clause weighs more. Insult words and word stems are learned from a
bounded labelled sample. A logistic model turns what the clauses of a text score into one probability; it sees nothing
but clauses, so a word that is negated or reported away counts for little however often it stands there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, labelled_sample, python_batches, quoted, table, unused

#: Labelled rows, and bytes of their texts, that the fit reads at most.
MOST_LABELLED, MOST_BYTES = 8000, 256 << 20
#: A learned word or stem needs this log-odds, and this share of the toxic texts (4 at least).
LEAST_WEIGHT, LEAST_SHARE, LEAST_TEXTS = 2.0, 0.01, 4
#: Of one word, so many uses in a text count; a clause scores at most MOST_CLAUSE.
MOST_USES, MOST_CLAUSE = 3, 10.0
#: Lengths of stems; a stem matches longer words only.
STEMS = range(4, 9)
MOST_ENTRIES = 4000
#: Score from which a text is toxic.
REJECT = 0.7
MOD, HELD_OUT = 3, 1

# Fixed word lists of the lexical transducer, in English, German, French and Spanish; insults are also learned.
INSULTS = (
    "idiot idiots idiotic moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb dumbass imbecile jerk creep filth vermin coward cretin bastard "
    "idioten idiotin trottel dummkopf versager abschaum widerlich erbärmlich wertlos dumm blödmann arschloch depp schwachkopf feigling mistkerl drecksack ungeziefer "
    "idiote idiots imbécile crétin crétine abruti abrutie minable ordure dégoûtant pathétique stupide salaud connard lâche nul raclure débile vermine "
    "idiota idiotas imbécil imbéciles estúpido estúpida basura escoria inútil asqueroso asquerosa patético patética tonto tonta cobarde payaso miserable perdedor cretino"
)
THREATS = (
    "kill kills killed killing hurt hurting destroy destroying murder murdering stab stabbing shoot shooting strangle strangling beat beating crush burn "
    "töten töte umbringen umbringe vernichten vernichte erschießen erwürgen erstechen verprügeln schlagen zerstören "
    "tuer tue tuerai frapper frapperai détruire détruirai étrangler poignarder massacrer brûler écraser "
    "matar mataré mato golpear golpearé destruir destruiré apuñalar estrangular quemar aplastar"
)
TARGETS = "you your yours yourself u he she they them him her du dich dir dein deine ihr euch sie er ihn tu te toi vous il elle lui usted ustedes ellos ellas él ti"
NEGATIONS = "not no never none without isn aren wasn don doesn didn nicht kein keine keinen nie ne pas jamais aucun nunca ni sin ningún"
REPORTS = "said says say told claimed called wrote reported quoted according sagte sagt meinte schrieb laut dit disait écrit selon dijo dice escribió según"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LATE = "O", "I", "H", "T", "N", "R", "D"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;\n]+")

# A transducer: its arcs by (state, symbol), each to (state, symbol, factor). State 0 begins every clause.
Transducer = dict[tuple[int, str], tuple[int, str, float]]


def window(opens: str, width: int, touches: str, factor: float, alphabet=SYMBOLS) -> Transducer:
    """After `opens`, the next `width` symbols (0: all to the end) found in `touches` are weighed by `factor`."""
    last = width or 1
    arcs: Transducer = {}
    for state in range(last + 1):
        after = max(state - 1, 0) if width else state
        for x in alphabet:
            arcs[state, x] = (last, x, 1.0) if x == opens else (after, x, factor if state and x in touches else 1.0)
    return arcs


def aimed(alphabet=SYMBOLS) -> Transducer:
    """States: no target yet, target seen, insult seen without one. A target that comes late is emitted as LATE."""
    arcs: Transducer = {}
    for state in (0, 1, 2):
        for x in alphabet:
            if x == TARGET:
                arcs[state, x] = (1, LATE if state == 2 else x, 1.0)
            elif x == INSULT:
                arcs[state, x] = (state or 2, x, 1.5 if state == 1 else 1.0)
            elif x == THREAT:
                arcs[state, x] = (state or 2, x, 1.0 if state == 1 else 0.3)
            else:
                arcs[state, x] = (state, x, 1.0)
    return arcs


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that feeds first's output to second; factors multiply, and pairs of states are numbered as reached."""
    symbols = {x for _, x in first}
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        pair = todo.pop()
        for x in symbols:
            a, y, f = first[pair[0], x]
            b, z, g = second[pair[1], y]
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], x] = (number[a, b], z, f * g)
    return arcs


def grammar() -> Transducer:
    """Negation (three words), then reported speech (to the clause's end), then targets."""
    return compose(compose(window(NEGATION, 3, INSULT + THREAT, 0.2), window(REPORT, 0, INSULT + THREAT, 0.5)), aimed())


@dataclass
class Model:
    """What a fit has learned; small, and sent to the tasks with the function that uses it."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, ...] = (-4.5, 2.0, 0.0, 0.5, 0.0)

    def weight(self, word: str) -> float:
        """Of the word, or else of its longest stem; 0 without either."""
        if word in self.words:
            return self.words[word]
        for n in range(min(STEMS[-1], len(word) - 1), STEMS[0] - 1, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0.0


class Matcher:
    """Runs the grammar over texts; weights are remembered for a fixed number of words of at most 128 characters."""

    def __init__(self, model: Model):
        self.model, self.arcs, self.known = model, grammar(), {}
        classes = ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS))
        self.symbol = {w: s for s, words in classes for w in words.split()}

    def of(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 200_000:
                self.known.clear()
            w = 3.0 if self.symbol.get(word) == THREAT else self.model.weight(word)
            if len(word) <= 128:
                self.known[word] = w
        return w

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The words of each clause; a colon ends one unless it opens what somebody is said to have said."""
        for part in CLAUSE.split(text):
            if ":" not in part:
                yield WORD.findall(part)
                continue
            words: list[str] = []
            reported = False
            for piece in part.split(":"):
                if words and not reported:
                    yield words
                    words = []
                new = WORD.findall(piece)
                reported = reported or any(self.symbol.get(w) == REPORT for w in new)
                words.extend(new)
            yield words

    def clause(self, words: list[str], plain: set[str] | None = None) -> float:
        """The clause's score; words that count in full there are added to `plain`."""
        state, total = 0, 0.0
        for word in words:
            symbol = self.symbol.get(word, OTHER)
            w = 1.0 if symbol not in (OTHER, THREAT) else self.of(word)
            if symbol == OTHER and w:
                symbol = INSULT
            state, out, factor = self.arcs[state, symbol]
            if out in (INSULT, THREAT, LATE):
                total += w * factor
                if plain is not None and out == INSULT and factor >= 1:
                    plain.add(word)
        return min(total, MOST_CLAUSE)

    def features(self, text: str) -> tuple[float, ...]:
        """(1, log of the summed clause scores, highest clause score, log of the number of different words that count in full in
        their clauses, log of the clause scores per 100 clauses)."""
        low = text.lower()
        hits = {w for w in set(WORD.findall(low)) if self.of(w)}
        if not hits:
            return NOTHING
        n, scores, plain = 0, [], set()
        for words in self.clauses(low):
            n += bool(words)
            if not hits.isdisjoint(words):
                scores.append(self.clause(words, plain))
        return 1.0, math.log1p(sum(scores)), max(scores) / MOST_CLAUSE, math.log1p(len(plain)), math.log1p(100 * sum(scores) / n)


NOTHING = (1.0, 0.0, 0.0, 0.0, 0.0)


def _features(model: Model):
    def run(batches):
        match = Matcher(model)
        for pdf in batches:
            rows = [match.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "f": [list(r) for r in rows]})

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's steps; column 0 of x is the constant, which is not shrunk."""
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> Model:
    """The lexicon and the logistic model, from at most most_labelled labelled rows (and most_bytes bytes) outside the held-out fold.

    Without both labels in the sample, the fixed word lists and default coefficients serve.
    """
    spark = docs.sparkSession
    python_batches(spark)
    sample = labelled_sample(docs, labels, "toxic", MOD, HELD_OUT, most_labelled, most_bytes)
    # A word counts once for each different text, however often that is copied.
    texts = sample.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.first("text").alias("text"))
    counts = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model({w: 3.0 for w in INSULTS.split()})
    if not counts.get(0) or not counts.get(1):
        return model
    uses = texts.select("y", "h", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("w")).groupBy("y", "h", "w").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array(F.concat(F.lit("="), "w"), *[F.when(F.length("w") > n, F.substring("w", 1, n)) for n in STEMS])
    uses = uses.filter(F.length("w") >= 3).select("y", "h", "n", "w", F.explode(F.array_compact(entries)).alias("e"))
    uses = uses.groupBy("y", "h", "e").agg(F.least(F.sum("n"), F.lit(MOST_USES)).alias("n"), F.min("w").alias("w"), F.max("w").alias("v"))
    found = uses.groupBy("e").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("a"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("b"), F.sum("y").alias("texts"),
        # A stem stands for several words of toxic texts; one word alone has an entry of its own.
        (F.min(F.when(F.col("y") == 1, F.col("w"))) != F.max(F.when(F.col("y") == 1, F.col("v")))).alias("several"),
    )
    least = max(LEAST_TEXTS, LEAST_SHARE * counts[1])
    odds = F.log((F.col("a") + 0.5) / (counts[1] + 1)) - F.log((F.col("b") + 0.5) / (counts[0] + 1))
    found = found.withColumn("w", odds).filter((F.col("texts") >= least) & (F.col("w") >= LEAST_WEIGHT) & (F.col("several") | F.col("e").startswith("=")))
    for r in found.orderBy(F.desc(F.col("a") * F.col("w")), "e").limit(MOST_ENTRIES).collect():
        (model.words if r["e"][0] == "=" else model.stems)[r["e"].removeprefix("=")] = float(r["w"])
    rows = sample.select("text", "y").mapInPandas(_features(model), "y int, f array<double>").toPandas()
    model.coef = tuple(logistic(np.array(rows["f"].tolist()), rows["y"].to_numpy(float)))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and n_hits, the number of different toxic words that count in full; no row goes and no shuffle happens.

    Null and empty texts get the score of a text without hits, texts of any length are read whole, equal texts get equal
    scores, an empty table gives none. Columns of docs with these names are replaced, all others pass through.
    """
    python_batches(docs.sparkSession)

    @F.pandas_udf("struct<score double, n_hits int>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        match = Matcher(model)  # once a task
        for texts in batches:
            x = np.array([match.features(t or "") for t in texts]).reshape(-1, len(NOTHING))
            z = np.clip(x @ np.array(model.coef), -30, 30)
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-z)), "n_hits": np.rint(np.expm1(x[:, 3])).astype("int32")})

    names, (found,) = [c for c in docs.columns if c.lower() not in ("score", "n_hits")], unused(docs, "scored")
    return docs.select(*quoted(names), scored(F.col(text_col)).alias(found)).select(*quoted(names), f"{found}.score", f"{found}.n_hits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = (id_remainder(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted"), "n_hits")
