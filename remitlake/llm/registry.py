"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, hard_negatives, prefix_trie, url_filter
from .ann import op10_ann
from .hard_negatives import op12_hard_negatives
from .license_scan import op6_license_scan
from .mixing import op1_mixing
from .near_dedup import op4_near_dedup
from .piece_codec import op5_piece_codec
from .prefix_trie import op13_prefix_trie
from .quality_fm import op3_quality_fm
from .quality_rules import op9_quality_rules
from .sharding import op2_sharding
from .token_counts import op8_token_counts
from .token_files import op7_token_files
from .url_filter import op11_url_filter

_QUERIES = (op1_mixing, op2_sharding, op3_quality_fm, op4_near_dedup, op5_piece_codec, op6_license_scan, op7_token_files, op8_token_counts, op9_quality_rules, op10_ann,
            op11_url_filter, op12_hard_negatives, op13_prefix_trie)

#: The other operators draw on hashes, models, files or state that SQL has not; tests/llm holds them
#: against brute force, exact round trips or held-out labels instead.
ORACLE_SQL: dict[str, str] = {"op11_url_filter": url_filter.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_prefix_trie": prefix_trie.SQL}


def _shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return f(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in _QUERIES}
