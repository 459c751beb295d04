"""Every stage on its own input, and the whole."""

import corpus_pipeline
from pyspark.sql import functions as F

from tracewarden.llm import toxicity
from tracewarden.llm.common import table

from test_copies import expected

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, SF)
        rows = docs.toPandas()
        if name != "bpe":
            assert list(rows.columns) == corpus_pipeline.COLUMNS
        if name == "toxicity":
            scored = toxicity.score(spark.createDataFrame(before), toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))).toPandas()
            assert set(rows["doc_id"]) == set(scored["doc_id"][scored["score"] < 0.7])
            marks = table(spark, SF, "labels").toPandas().set_index("doc_id")["toxic"]
            toxic, clean = set(marks.index[marks == 1]), set(marks.index[marks == 0])
            assert clean & set(before["doc_id"]) <= set(rows["doc_id"]) and len(toxic & set(rows["doc_id"])) <= 0.5 * len(toxic)
        elif name == "exact_dedup":
            low = before["text"].str.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            assert set(rows["doc_id"]) == set(before.groupby(low)["doc_id"].max())
        elif name == "near_dedup":
            component = expected(list(before[["doc_id", "text"]].itertuples(index=False, name=None)), corpus_pipeline.WIDTH)
            assert sorted(rows["doc_id"]) == sorted(i for i, c in component.items() if i == c) and len(rows) < len(before)
        elif name == "mixing":
            words = rows["text"].str.split().str.len().sum() / before["text"].str.split().str.len().sum()
            assert 1.3 < words < 1.7 and rows["doc_id"].value_counts().max() == 2
        else:
            assert len(rows) == len(before)
        docs = spark.createDataFrame(rows, docs.schema)


def test_stages_take_odd_and_empty_tables(spark, odd):
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            if name == "near_dedup":
                assert docs.filter(F.col("doc_id").isNull()).count() <= 2
