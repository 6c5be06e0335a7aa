"""Registered queries of this subpackage, and the DuckDB statement of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .q_chat import op9_chat_format
from .q_codes import OP13_SQL, op13_laesa_codes
from .q_fingerprints import OP11_SQL, op11_spot_signatures
from .q_language import op1_language_id
from .q_license import op6_license_scan
from .q_near import OP3_SQL, op3_near_dedup
from .q_neighbours import op10_nn_descent
from .q_packing import op5_best_fit_packing
from .q_pieces import op8_sentencepiece
from .q_resampling import OP12_SQL, op12_importance_resampling
from .q_search import OP2_SQL, op2_bm25_search
from .q_substring import OP7_SQL, op7_substring_dedup
from .q_warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bm25_search": op2_bm25_search,
    "op3_near_dedup": op3_near_dedup,
    "op4_warc": op4_warc,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_chat_format": op9_chat_format,
    "op10_nn_descent": op10_nn_descent,
    "op11_spot_signatures": op11_spot_signatures,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_laesa_codes": op13_laesa_codes,
}
ORACLES: dict[str, str] = {
    "op2_bm25_search": OP2_SQL,
    "op3_near_dedup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_spot_signatures": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_laesa_codes": OP13_SQL,
}
