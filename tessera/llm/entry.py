"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .decontam import OP4_SQL, op4_decontamination
from .langid import op6_language_id
from .mixing import op9_mixing
from .neardup import op2_minhash
from .quality_rules import op10_quality_rules
from .repeats import op7_suffix_dedup
from .secrets import op8_secrets
from .sharding import op5_sharding
from .toxicity import op1_toxicity
from .warc import OP3_SQL, op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (op1_toxicity, op2_minhash, op3_warc, op4_decontamination, op5_sharding, op6_language_id, op7_suffix_dedup, op8_secrets, op9_mixing, op10_quality_rules)
    return {f.__name__: f for f in fs} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_decontamination": OP4_SQL}
