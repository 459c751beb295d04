"""Queries against their DuckDB SQL, and columns whose names clash with what operators use inside."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import bpe, catalog, chat, exact_dedup, quality_classifier, quality_rules, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    found, expected = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert [r.replace(".0", "") for r in rows(found)] == [r.replace(".0", "") for r in rows(expected)]


def test_clashing_names_pass_through(spark, odd):
    mine = {"__found": F.lit(1), "__FOUND_": F.lit(2), "len": F.lit(3), "row": F.lit(4), "words": F.lit(5), "a.b": F.lit(6)}
    docs, path = odd.withColumns(mine), public_tokenizers.path(bpe.VOCABULARY)
    passed = "__found = 1 AND `__FOUND_` = 2 AND len = 3 AND row = 4 AND words = 5 AND `a.b` = 6"
    for out in (
        exact_dedup.exact_dedup(docs), quality_rules.quality_rules(docs), bpe.round_trip(docs, path), bpe.decode(bpe.encode(docs, path), path),
        token_counts.count_tokens(docs, path), quality_classifier.score(docs, quality_classifier.fresh()), chat.read_back(chat.format_chats(docs.withColumn("record", F.col("text")))),
    ):
        assert out.filter(passed).count() == odd.count()


def test_chats_of_empty_tables_and_very_long_texts(spark, make):
    turns = spark.createDataFrame([(1, 1, "user", "x" * 300_000), (1, 2, "assistant", "<s>" * 50_000)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_chats(chat.records_of(turns.withColumn("ts", F.lit(1))))).first()
    assert got["n_turns"] == 2 and got["loss_chars"] == 150_000 and got["formatted_chars"] > 500_000
    assert chat.read_back(chat.format_chats(chat.records_of(turns.limit(0)))).count() == 0


def test_rules_leave_other_scripts_and_figures_alone(make):
    lines = ["A日本語の文章はここにありますがとても長いのでこの行は四十文字をこえてしまいます。", "B 12.5 17.8 22.1 90.4 11.3 55.2 77.1 38.6 10.9 44.0 12.2", "NEUE ÄNDERUNGEN SIND JETZT DA UND ALLE SOLLEN LESEN."]
    got = {r["doc_id"]: r["n_lines_removed"] for r in quality_rules.quality_rules(make(lines)).collect()}
    assert got == {0: 0, 1: 0, 2: 1}
