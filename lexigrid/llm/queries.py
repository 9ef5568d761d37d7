"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .curriculum import op4_curriculum
from .curvepack import op2_curve_packing
from .licenses import op8_licenses
from .linechunks import op5_line_chunks
from .media import op10_media
from .neardup import op6_near_duplicates
from .prefixhash import op9_fingerprints
from .quality import op1_quality
from .sql import OP4
from .tokenbin import op7_token_ids
from .toxicity import op3_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus; the script at the repository's top puts the operators together."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_curve_packing": op2_curve_packing,
    "op3_toxicity": op3_toxicity,
    "op4_curriculum": op4_curriculum,
    "op5_line_chunks": op5_line_chunks,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_ids": op7_token_ids,
    "op8_licenses": op8_licenses,
    "op9_fingerprints": op9_fingerprints,
    "op10_media": op10_media,
    "pipeline": pipeline,
}
#: The pipeline has no SQL: none can express its fitted rules and signatures.
ORACLES = {"op4_curriculum": OP4}
