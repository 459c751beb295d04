"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, fill_in_middle, lexical_search, mixing, near_dedup, quality_classifier, quality_rules, simhash, token_counts, toxicity, warc

_QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_source_mixing": mixing.query,
    "op3_chat_format": chat.query,
    "op4_token_counts": token_counts.query,
    "op5_warc": warc.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_bpe": bpe.query,
    "op9_near_dedup": near_dedup.query,
    "op10_quality_rules": quality_rules.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_lexical_search": lexical_search.query,
    "op13_simhash": simhash.query,
}
#: The others hold models, random choices, tokenizers or iterations, which SQL cannot express.
_ORACLES = {
    "op3_chat_format": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}


def queries() -> dict:
    import corpus_pipeline

    return {**_QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    return {**_ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
