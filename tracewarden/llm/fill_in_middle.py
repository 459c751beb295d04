"""Fill-in-middle by ropes.

A text is a balanced tree whose leaves hold pieces of it and cache how many units (code points, words or lines) and how
many code points they have. Two unit ranks split the tree into prefix, middle and suffix; the subtrees are joined again
in another order, with sentinels between them, and only the result is written out. The way back splits the tree of the
output at the sentinels.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches, quoted, table, unused

#: Code points of a leaf; a longer unit has a leaf of its own.
LEAF = 2048
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents that are rearranged, and of these such with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: What a unit is: a code point, a word with the space before it, or a line with its end. What no match covers belongs to the last unit.
UNITS = {"char": None, "word": re.compile(r"\s*\S+"), "line": re.compile(r"[^\n]*\n|[^\n]+")}


class Rope:
    """A leaf (text) or a node (left, right), with its numbers of units and code points and its height."""

    __slots__ = ("text", "left", "right", "units", "chars", "height")

    def __init__(self, text: str | None, units: int, chars: int, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right, self.units, self.chars = text, left, right, units, chars
        self.height = 1 + max(left.height, right.height) if left else 0

    def pieces(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.left:
                stack += (node.right, node.left)
            else:
                out.append(node.text)
        return out

    def __str__(self) -> str:
        return "".join(self.pieces())


def _ends(text: str, pattern: re.Pattern) -> list[int]:
    """Where each unit ends; the last one ends with the text."""
    ends = [m.end() for m in pattern.finditer(text)]
    return [*ends[:-1], len(text)] if text else []


def _leaf(text: str, pattern: re.Pattern | None) -> Rope:
    return Rope(text, len(_ends(text, pattern)) if pattern else len(text), len(text))


def _node(left: Rope, right: Rope) -> Rope:
    return Rope(None, left.units + right.units, left.chars + right.chars, left, right)


def rope(text: str, pattern: re.Pattern | None = None) -> Rope:
    """The tree of a text; leaves end where units end."""
    if len(text) <= LEAF:
        return _leaf(text, pattern)
    if pattern is None:
        level = [Rope(text[k : k + LEAF], min(LEAF, len(text) - k), min(LEAF, len(text) - k)) for k in range(0, len(text), LEAF)]
    else:
        level, begin, units = [], 0, 0
        for end in _ends(text, pattern):
            units += 1
            if end - begin >= LEAF or end == len(text):
                level.append(Rope(text[begin:end], units, end - begin))
                begin, units = end, 0
    return _tree(level)


def _tree(leaves: list[Rope]) -> Rope:
    half = len(leaves) // 2
    return _node(_tree(leaves[:half]), _tree(leaves[half:])) if half else leaves[0]


def join(left: Rope | None, right: Rope | None) -> Rope | None:
    """Both texts one after the other; the taller tree takes the other in where their heights meet."""
    if not left or not right:
        return left or right
    if left.height > right.height + 1:
        return _balanced(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(join(left, right.left), right.right)
    return _node(left, right)


def _balanced(left: Rope, right: Rope) -> Rope:
    if right.height > left.height + 1:
        inner = right.left
        if inner.height > right.right.height:
            return _node(_node(left, inner.left), _node(inner.right, right.right))
        return _node(_node(left, inner), right.right)
    if left.height > right.height + 1:
        inner = left.right
        if inner.height > left.left.height:
            return _node(_node(left.left, inner.left), _node(inner.right, right))
        return _node(left.left, _node(inner, right))
    return _node(left, right)


def split(node: Rope | None, rank: int, by: str = "units", pattern: re.Pattern | None = None) -> tuple[Rope | None, Rope | None]:
    """The first `rank` units (or code points, by="chars") and the rest; None where a side is empty."""
    if not node or rank <= 0:
        return None, node
    if rank >= getattr(node, by):
        return node, None
    if node.left:
        inside = getattr(node.left, by)
        if rank < inside:
            left, right = split(node.left, rank, by, pattern)
            return left, join(right, node.right)
        left, right = split(node.right, rank - inside, by, pattern)
        return join(node.left, left), right
    at = rank if by == "chars" or pattern is None else _ends(node.text, pattern)[rank - 1]
    if by == "units":
        return Rope(node.text[:at], rank, at), Rope(node.text[at:], node.units - rank, node.chars - at)
    return _leaf(node.text[:at], pattern), _leaf(node.text[at:], pattern)


def _mark(text: str) -> Rope:
    return Rope(text, 0, len(text))


def rearranged(text: str, one: int, two: int, turn: int, first: int, unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(units, form, prefix's code points, middle's code points, output); one and two choose the cuts, turn and first the form."""
    pattern = UNITS[unit]
    tree = rope(text, pattern)
    n = tree.units
    if not text or turn % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    rest, suffix = split(tree, b, "units", pattern)
    prefix, middle = split(rest, a, "units", pattern)
    parts = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if first % 100 < suffix_first else ("psm", (PREFIX, SUFFIX, MIDDLE))
    out = None
    for name in order:
        out = join(join(out, _mark(name)), parts[name])
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, str(out)


def restored(output: str, form: str) -> str:
    """The text that an output was made of; parts hold no sentinel, so the first of each in its order is the mark."""
    if form not in ("psm", "spm"):
        return output
    order, tree, parts, at = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE), rope(output), {}, []
    for name in order:
        at.append(output.index(name, at[-1] if at else 0))
    for name, k in reversed(list(zip(order, at, strict=True))):
        tree, tail = split(tree, k, "chars")
        parts[name] = split(tail, len(name), "chars")[1]
    return str(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]) or "")


def draws(key: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2^32 from a digest of seed and key."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


NEW = ["n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars and output.

    unit is char, word or line. Cuts and forms follow from the id and the seed alone, so repeated rows get equal outputs and
    reruns agree; null ids draw as the empty id. Null texts count as empty; empty texts and those that hold a sentinel stay
    plain. Texts of any length are read whole, an empty table gives none. Columns with the names above are replaced, all
    others pass through. No shuffle.
    """
    python_batches(docs.sparkSession)
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit!r}")

    @F.pandas_udf("struct<n long, form string, prefix_chars long, middle_chars long, output string>")
    def run(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [rearranged(t or "", *draw, unit, rate, suffix_first) for t, *draw in zip(texts, a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)]
        out = pd.DataFrame(rows, columns=NEW)
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    names, (made,) = quoted([c for c in docs.columns if c.lower() not in NEW]), unused(docs, "made")
    out = docs.select(*names, run(*quoted([text_col]), *draws(quoted([id_col])[0], seed)).alias(made))
    return out.select(*names, *[F.col(f"{made}.{c}") for c in NEW])


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "restored") -> DataFrame:
    """made with the text that each output came from; null outputs give the empty text. A column `out` is replaced. No shuffle."""
    python_batches(made.sparkSession)

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o or "", f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return made.withColumn(out, run(*quoted([output_col, form_col])))


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document rearranged and brought back, with digests of both."""
    made = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return made.select(*COLUMNS, digest("output"), digest("restored"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
