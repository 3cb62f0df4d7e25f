"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_scan, line_dedup, ngram_join
from .audio import op2_audio_features
from .byte_bpe import op5_byte_bpe
from .license_scan import op10_license_scan
from .line_dedup import op9_line_dedup
from .ngram_join import op3_ngram_join
from .packing import op7_best_fit_packing
from .quality import op8_quality
from .secret_scan import op4_secret_scan
from .spotsigs import op6_spotsigs, op6_spotsigs_classes
from .token_store import op1_token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_store, op2_audio_features, op3_ngram_join, op4_secret_scan, op5_byte_bpe, op6_spotsigs, op6_spotsigs_classes, op7_best_fit_packing, op8_quality, op9_line_dedup, op10_license_scan)}
ORACLES: dict[str, str] = {"op3_ngram_join": ngram_join.oracle(), "op9_line_dedup": line_dedup.oracle(), "op10_license_scan": license_scan.oracle()}
