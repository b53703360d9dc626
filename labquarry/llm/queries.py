"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op3_ivf_pq
from .exact import OP13_SQL, op13_streaming_dedup
from .jaccard import OP8_SQL, op8_chosen_path_join
from .langid import op6_language_bitmask_filters
from .lexical import OP11_SQL, op11_tiered_index
from .lifetimes import OP12_SQL, op12_batch_lifetimes
from .mixing import op2_pivotal_rounding
from .packing import op10_minimum_bin_slack
from .pii import op9_candidate_boosting
from .quotes import OP1_SQL, op1_quotation_linking
from .rangejoin import OP5_SQL, op5_metric_range_join
from .sharding import op4_fixed_virtual_slots
from .suffixes import op7_sampled_suffix_sort


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quotation_linking,
        op2_pivotal_rounding,
        op3_ivf_pq,
        op4_fixed_virtual_slots,
        op5_metric_range_join,
        op6_language_bitmask_filters,
        op7_sampled_suffix_sort,
        op8_chosen_path_join,
        op9_candidate_boosting,
        op10_minimum_bin_slack,
        op11_tiered_index,
        op12_batch_lifetimes,
        op13_streaming_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_linking": OP1_SQL, "op5_metric_range_join": OP5_SQL, "op8_chosen_path_join": OP8_SQL, "op11_tiered_index": OP11_SQL, "op12_batch_lifetimes": OP12_SQL, "op13_streaming_dedup": OP13_SQL}
