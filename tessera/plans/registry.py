"""All registered queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import contract_queries, delivery_queries, sentence_queries, statistic_queries, table_queries
from .views import Views

_ALL = sentence_queries.ALL | table_queries.ALL | statistic_queries.ALL | contract_queries.ALL | delivery_queries.ALL

#: Queries whose plans would cut the documents into sentences three times or more.
_HELD = frozenset(
    "e1_spearman e2_cluster_mean_ci e2_cluster_median_ci e4_proportion_ci e5_rank_corr_ci e8_interval e9_support e10_standardised e11_standardised_ci e19_paired_contrast "
    "e20_invariance e22_span_ratio e27_models_standardised j1_three_way j3_lockstep s17_canonical_freeze s20_score_maps v9_replay w1_avg_rank w2_mid_rank "
    "w5_quintiles w11_disagreement w17_weighted_quantile x3_adapted_runs x3_run_variability x3_runs".split()
)
QUERIES = {name: (lambda spark, sf_dir, make=make, held=name in _HELD: make(Views(spark, sf_dir, held))) for name, (make, _) in _ALL.items()}
SQL = {name: text for name, (_, text) in _ALL.items() if text is not None}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents to sentences to the strict subset to score statistics by corpus."""
    return QUERIES["a6_score_stats"](spark, sf_dir)
