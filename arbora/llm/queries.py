"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm.ego_join import op3_ego_join
from arbora.llm.html import op5_page_differencing
from arbora.llm.mixing import OP4_SQL, op4_pareto_mix
from arbora.llm.near_dedup import op10_prob_minhash
from arbora.llm.packing import op1_mixture_packing
from arbora.llm.pii import op8_pii_surrogates
from arbora.llm.quality import op6_byte_cnn
from arbora.llm.sharding import op9_bounded_load_ring
from arbora.llm.threshold import OP7_SQL, op7_threshold_top_k
from arbora.llm.token_store import op2_orc_token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixture_packing, op2_orc_token_store, op3_ego_join, op4_pareto_mix, op5_page_differencing, op6_byte_cnn,
        op7_threshold_top_k, op8_pii_surrogates, op9_bounded_load_ring, op10_prob_minhash,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_pareto_mix": OP4_SQL, "op7_threshold_top_k": OP7_SQL}
