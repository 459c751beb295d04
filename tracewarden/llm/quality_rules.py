"""Line-first quality rules, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a document goes
if its base counts fail or if cleaning removes more than half of its characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, quoted, table

# Line rules as patterns that Java's and RE2's engines read alike.
#: Punctuation: three runs of symbols, five double exclamation marks, eight words in capitals, eight words without any stop.
SYMBOL_RUNS = r"([#*$%&]{3}[^#*$%&]*){3}"
EXCLAIMS = r"(!![^!]*){5}"
CAPITALS = r"(^|[^\p{Lu}])(\p{Lu}{2,}[ ,.!?-]+){7}\p{Lu}{2}"  # tried where a run of capitals begins, so a very long run takes linear time
EIGHT_WORDS = r"^ *([^ ]+ +){7}[^ ]"  # anchored: one attempt a line, so a very long word takes linear time
STOP = r"[.!?;:,。！？、…]"
#: Navigation: three separators between labels.
NAVIGATION = r"([|>»·][^|>»·]*){3}"
#: Boilerplate phrases, looked for in lower case: English, German, French, Spanish.
BOILERPLATE = [
    "all rights reserved", "licensed under", "privacy policy", "terms of use", "terms of service", "cookie policy", "cookie settings", "click here", "enable javascript", "subscribe to our newsletter",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-einstellungen", "hier klicken", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "conditions d’utilisation", "paramètres des cookies", "cliquez ici", "abonnez-vous",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "configuración de cookies", "haga clic aquí", "suscríbase",
]

LEAST_WORDS = 50
#: Per cent: of words in repeated windows at most; of characters that cleaning leaves at least.
MOST_REPEATED, LEAST_LEFT = 50, 50


def holds_boilerplate(small: Column) -> Column:
    """One plain search a phrase: a pattern of as many branches tries them all at every character."""
    return reduce(Column.__or__, [small.contains(p) for p in BOILERPLATE])


def line_fails(line: Column, small: Column) -> Column:
    """Whether a line breaks a rule; small is the line in lower case, made once for all phrases."""
    return (
        line.rlike(SYMBOL_RUNS)
        | line.rlike(EXCLAIMS)
        | line.rlike(CAPITALS)
        | (line.rlike(EIGHT_WORDS) & ~line.rlike(STOP))
        | line.rlike(NAVIGATION)
        | holds_boilerplate(small)
    )


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, left_chars, cleaned_text,
    base_failed and kept.

    Null texts count as empty and fail by their number of words. Rows are judged alone: repeated rows get equal
    results, an empty table gives none, columns of docs with the names above are replaced, and all others pass through.
    Texts, lines and words of any length are read whole, in time that grows with their length alone.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "left_chars", "cleaned_text", "base_failed", "kept"]
    passed = [c for c in docs.columns if c.lower() not in names]
    out = docs.select(F.struct(*quoted(passed)).alias("row")).withColumn("t", F.coalesce(F.col("row")[text_col], F.lit("")))
    out = out.withColumns({
        "words": F.array_remove(F.split("t", f"[{SPACE}]+"), ""),
        "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(rf"[^{SPACE}]")),
        "n_symbols": (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long"),
        "word_chars": F.length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long"),
    })
    # One hash for each 3-word window; `get` gives null past the end, which the filter on position removes.
    out = out.withColumns({
        "n_words": F.size("words").cast("long"),
        "windows": F.slice(
            F.transform("words", lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p"))),
            1, F.greatest(F.size("words") - 2, F.lit(0)),
        ),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "good": F.transform(
            F.filter(F.transform("lines", lambda x: F.struct(x.alias("line"), F.lower(x).alias("small"))), lambda x: ~line_fails(x["line"], x["small"])), lambda x: x["line"]
        ),
    })
    out = out.withColumn("hashes", F.col("windows.h"))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    # Sorted by hash, a repeated window stands next to its equal.
    out = out.withColumn("sorted", F.when(repeats, F.sort_array("windows")).otherwise(F.slice("windows", 1, 0)))
    same = lambda x, i: (F.get("sorted", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("sorted", i - 1)["h"] == x["h"]))
    out = out.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"])))
    # A window covers three words, fewer where the next repeated window begins earlier.
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x))
    left = F.aggregate("good", F.lit(0), lambda a, x: a + F.length(x))
    out = out.withColumns({
        "n_repeat_words": covered.cast("long"),
        "n_lines_removed": (F.size("lines") - F.size("good")).cast("long"),
        "left_chars": left.cast("long"),
        "total": total.cast("long"),
        "cleaned_text": F.array_join("good", "\n"),
    })
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "kept": ~failed & (100 * F.col("left_chars") >= LEAST_LEFT * F.col("total"))})
    return out.select(*[F.col("row")[c].alias(c) for c in passed], *names)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "left_chars"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(COLUMNS)


SQL_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in BOILERPLATE) + "]"

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS win
  FROM (SELECT doc_id, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS w FROM d WHERE len(ws) >= 3)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
good AS (
  SELECT doc_id, list_filter(ls, lambda x: NOT (
      regexp_matches(x, '{SYMBOL_RUNS}') OR regexp_matches(x, '{EXCLAIMS}') OR regexp_matches(x, '{CAPITALS}')
      OR (regexp_matches(x, '{EIGHT_WORDS}') AND NOT regexp_matches(x, '{STOP}'))
      OR regexp_matches(x, '{NAVIGATION}') OR list_bool_or([contains(lower(x), p) FOR p IN {SQL_PHRASES}]))) AS gl
  FROM d),
b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (len(ls) - len(gl))::BIGINT AS n_lines_removed,
         coalesce(list_sum(list_transform(gl, lambda x: length(x))), 0)::BIGINT AS left_chars,
         coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0)::BIGINT AS total
  FROM d JOIN good USING (doc_id) LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * left_chars >= {LEAST_LEFT} * total AS kept, n_lines_removed, left_chars
FROM f
"""
