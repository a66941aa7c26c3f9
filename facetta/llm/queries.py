"""The queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .chat import op8_chat
from .decontaminate import op3_decontamination
from .fingerprints import op4_fingerprints
from .html import op5_html
from .langid import op7_language_id
from .mixing import op9_mixing
from .quality import op6_quality
from .sharding import op1_sharding
from .simhash import op10_simhash
from .suffixes import op2_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_suffix_dedup, op3_decontamination, op4_fingerprints, op5_html, op6_quality, op7_language_id, op8_chat, op9_mixing, op10_simhash)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": oracle.OP2, "op3_decontamination": oracle.OP3, "op8_chat": oracle.OP8, "op9_mixing": oracle.OP9}
