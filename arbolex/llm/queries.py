"""Registration of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import automata, chat, common, decontamination, induced, langid, negatives, oracles, packing, pieces, pii, quality, sharding, simhash, variants

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return f(spark, sf_dir)

    return run


_QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_template_windows": decontamination.op1_template_windows,
    "op2_suffix_automata": automata.op2_suffix_automata,
    "op3_induced_sorting": induced.op3_induced_sorting,
    "op4_bk_trees": simhash.op4_bk_trees,
    "op5_boosted_candidates": pii.op5_boosted_candidates,
    "op6_tournament_packing": packing.op6_tournament_packing,
    "op7_sampled_splitters": sharding.op7_sampled_splitters,
    "op8_partial_matching": langid.op8_partial_matching,
    "op9_tool_call_linking": chat.op9_tool_call_linking,
    "op10_repetition_coverage": quality.op10_repetition_coverage,
    "op11_score_agenda": pieces.op11_score_agenda,
    "op12_pigeonhole_variants": variants.op12_pigeonhole_variants,
    "op13_ball_tree_negatives": negatives.op13_ball_tree_negatives,
}
QUERIES = {name: _shipped(f) for name, f in _QUERIES.items()}
ORACLES: dict[str, str] = {
    "op2_suffix_automata": oracles.WORDS,
    "op3_induced_sorting": oracles.BYTES,
    "op9_tool_call_linking": oracles.MESSAGES,
    "op10_repetition_coverage": oracles.QUALITY,
    "op12_pigeonhole_variants": oracles.VARIANTS,
    "op13_ball_tree_negatives": oracles.NEGATIVES,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
