"""The queries of this package and, where SQL can express them, their equals in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .graph_ann import op2_neighbours
from .html_text import op1_html
from .langid import op4_language_id
from .mixing import op10_mixing, oracle
from .packing import op6_packing
from .quality import op3_quality
from .secrets import op5_secrets
from .simhash import op7_simhash
from .toxicity import op9_toxicity
from .wordpiece import op8_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html, op2_neighbours, op3_quality, op4_language_id, op5_secrets, op6_packing, op7_simhash, op8_token_counts, op9_toxicity, op10_mixing)}
ORACLE_SQL: dict[str, str] = {"op10_mixing": oracle()}
