"""Registered queries of the training-data operators: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_tree, conversation_repair, exact_topk, html_text, jaccard_join, merge_dropout, mixing, pii, quality, rules, run_detection, token_counts, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _labelled(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": _labelled(toxicity.score_all),
        "op2_pii_disclosure": _documents(pii.find_all),
        "op3_mixing": _labelled(mixing.mix_all),
        "op4_quality": _labelled(quality.score_all),
        "op5_token_counts": _documents(token_counts.count_all),
        "op6_jaccard_join": _documents(jaccard_join.join),
        "op7_html_text": lambda spark, sf_dir: html_text.extract_all(table(spark, sf_dir, "pages")),
        "op8_ann_tree": lambda spark, sf_dir: ann_tree.search_all(table(spark, sf_dir, "embeddings")),
        "op9_quality_rules": _labelled(rules.judge_all),
        "op10_merge_dropout": _documents(merge_dropout.encode_all),
        "op11_conversation_repair": lambda spark, sf_dir: conversation_repair.repair_all(table(spark, sf_dir, "conversations")),
        "op12_run_detection": _documents(run_detection.detect_all),
        "op13_exact_topk": lambda spark, sf_dir: exact_topk.search_all(table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    """What SQL can say; the other operators are tested against brute force or held-out rows."""
    return {"op13_exact_topk": TOPK_SQL}
