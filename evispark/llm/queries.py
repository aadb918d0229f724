"""Queries of the training-data operators, by name, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP1_SQL, op1_perspectives
from .divergence import OP11_SQL, op11_divergence
from .embedding_dedup import op4_embedding_dedup
from .line_dedup import op10_line_dedup
from .neighbours import op2_neighbours
from .packing import op3_packing
from .pieces import op8_pieces
from .quality_rules import op12_quality_rules
from .sharding import op9_sharding
from .simhash import op6_simhash
from .token_files import op7_token_files
from .toxicity import op5_toxicity
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_perspectives": op1_perspectives,
    "op2_neighbours": op2_neighbours,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_token_files": op7_token_files,
    "op8_pieces": op8_pieces,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op11_divergence": op11_divergence,
    "op12_quality_rules": op12_quality_rules,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_perspectives": OP1_SQL,
    "op11_divergence": OP11_SQL,
}
