"""Chat formatting: a fingerprint of nested field paths selects the declarative mapping to canonical turns.

Records come as JSON in different layouts (prompt and completion, instruction and output, lists of messages). The
sorted field paths of a record are hashed; the hash finds a mapping, which is data: which path holds which role, or
which list holds turns and under which names. Canonical turns are written in a template whose control strings cannot
occur inside roles and texts: these are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches, quoted, table, unused

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates and tokenizers treat as control; none survives inside a text.
CONTROL = [START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>"]
# A backslash goes behind the first character of a control string; backslashes of the text are doubled.
_ESCAPE = re.compile(r"\\|[<\[](?=" + "|".join(sorted({re.escape(s[1:]) for s in CONTROL})) + ")")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}\n", re.DOTALL)

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def paths(value, prefix: str = "") -> Iterator[str]:
    """Nested field paths; items of a list share one path, however many there are."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        yield f"{prefix}[]"
        for v in value:
            if isinstance(v, (dict, list)):
                yield from paths(v, f"{prefix}[]")
    else:
        yield prefix


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: Mappings by layout. `fields`: (role, path) in the order of the turns; `list`: where the turns are, and their names.
#: `optional` paths may be missing; a missing or empty optional field gives no turn.
LAYOUTS = {
    "prompt": {"fields": [("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")], "optional": ["system"]},
    "instruction": {"fields": [("system", "instruction"), ("user", "input"), ("assistant", "output")], "optional": ["input"]},
    "question": {"fields": [("user", "data.question"), ("assistant", "data.answer")]},
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "conversations": {"list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
}


def _expected(layout: dict) -> Iterator[set[str]]:
    """Every set of field paths that a record of this layout can have."""
    if "list" in layout:
        own = f"{layout['list']}[]"
        yield {own}  # no turns
        yield {own, f"{own}.{layout['role']}", f"{own}.{layout['text']}"}
        return
    sets = [{p for _, p in layout["fields"]}]
    for p in layout.get("optional", []):
        sets += [s - {p} for s in sets]
    yield from sets


MAPPINGS = {fingerprint(s): name for name, layout in LAYOUTS.items() for s in _expected(layout)}


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, name: str) -> list[Turn]:
    """The canonical turns of a record by the named mapping; null texts are empty."""
    layout = LAYOUTS[name]
    if "list" in layout:
        roles = layout.get("roles", {})
        said = ((as_text(m.get(layout["role"])), as_text(m.get(layout["text"]))) for m in record[layout["list"]])
        return [(roles.get(role, role), text) for role, text in said]
    out = []
    for role, path in layout["fields"]:
        value = record
        for step in path.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        if not (path in layout.get("optional", []) and not value):
            out.append((role, as_text(value)))
    return out


def render(turns: list[Turn], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the loss mask: spans of code points that hold the (escaped) texts of role `learn`."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[Turn]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def format_chats(records: DataFrame, json_col: str = "record") -> DataFrame:
    """records with layout, fingerprint, formatted and loss_spans (array of start and end in code points); no shuffle.

    A record that is null, no JSON object, or of an unknown layout keeps its row, with null layout and formatted text
    and no spans; its fingerprint is null only where there is no object. Columns with these names are replaced, all others
    pass through; records of any length are read whole, equal records get equal results, an empty table gives none.
    """
    python_batches(records.sparkSession)
    new = ["layout", "fingerprint", "formatted", "loss_spans"]

    @F.pandas_udf("struct<layout string, fingerprint string, formatted string, loss_spans array<struct<start int, stop int>>>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                record = json.loads(v) if v else None
            except ValueError:
                record = None
            key = fingerprint(set(paths(record))) if isinstance(record, dict) else None
            name = MAPPINGS.get(key)
            text, spans = render(turns_of(record, name)) if name else (None, [])
            rows.append((name, key, text, [{"start": a, "stop": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=new)

    names, (found,) = quoted([c for c in records.columns if c.lower() not in new]), unused(records, "found")
    return records.select(*names, run(F.col(json_col)).alias(found)).select(*names, *[F.col(f"{found}.{c}") for c in new])


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with what its output holds: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    Rows without a formatted text count as holding no turn. Columns with these names are replaced, all others pass through.
    """
    new = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    @F.pandas_udf("struct<n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long>")
    def run(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, masks, strict=True):
            text = text or ""
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            every = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((len(turns), _sha(every), len(loss), _sha(loss), len(text)))
        return pd.DataFrame(rows, columns=new)

    names, (found,) = quoted([c for c in formatted.columns if c.lower() not in new]), unused(formatted, "found")
    return formatted.select(*names, run("formatted", "loss_spans").alias(found)).select(*names, *[F.col(f"{found}.{c}") for c in new])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def records_of(turns: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as one JSON record for each conversation, in the layout that its roles suggest.

    Rows go by turn, then role and text; null roles and texts are empty. A row whose conv_id is null is a conversation
    of its own, so that such rows never meet in one group. Rows that are repeated are turns of their own; other columns are
    left out, and an empty table gives none. A conversation's turns are gathered in one row.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    all_turns = grouped.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("ts")))

    roles, text = F.col("ts.role"), lambda i: F.col("ts")[i]["text"]
    is_roles = lambda *names: roles == F.array(*map(F.lit, names))
    as_json = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    listed = lambda role, said, of: F.transform("ts", lambda t: F.struct(of(t["role"]).alias(role), t["text"].alias(said)))

    def shared(role: Column) -> Column:
        return F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)

    known = F.forall("ts", lambda t: t["role"].isin("user", "assistant", "system"))
    messages = as_json(messages=listed("role", "content", lambda r: r))
    record = (
        F.when(is_roles("user", "assistant"), as_json(prompt=text(0), completion=text(1)))
        .when(is_roles("system", "user", "assistant") & (text(1) != ""), as_json(instruction=text(0), input=text(1), output=text(2)))
        .when(known & (F.size("ts") % 2 == 1), as_json(conversations=listed("from", "value", shared)))
        .otherwise(messages)
    )
    return all_turns.select("conv_id", record.alias("record"))


#: A conversation whose texts hold control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def _added(text: str) -> str:
    """SQL for the number of characters that escaping adds to a text."""
    tails = sorted({s[1:] for s in CONTROL})
    marks = ["\\", *[f + t for f in "<[" for t in tails]]
    return " + ".join(f"(length({text}) - length(replace({text}, '{m}', ''))) // {len(m)}" for m in marks)


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, {_added('role')} + {_added('text')} AS added FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length(role) + length(text) + added + {len(START + SEP + END) + 1})::BIGINT AS formatted_chars,
        list(role ORDER BY turn NULLS FIRST, role, text) AS roles, list(text ORDER BY turn NULLS FIRST, role, text) AS texts FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN 'prompt' WHEN roles = ['system', 'user', 'assistant'] AND texts[2] <> '' THEN 'instruction'
    WHEN len(list_filter(roles, lambda r: r NOT IN ('user', 'assistant', 'system'))) = 0 AND n_turns % 2 = 1 THEN 'conversations' ELSE 'messages' END AS layout
FROM g
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every conversation and number -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    out = read_back(format_chats(records_of(turns.unionByName(hostile))))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout")
