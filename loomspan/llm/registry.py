"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op2_decontamination
from .html import op4_html
from .jaccard import op10_jaccard
from .langid import op5_language_id
from .lm import op8_lm
from .media import op9_media
from .merkle import ORACLE as MERKLE_SQL
from .merkle import op11_merkle
from .packing import op7_packing
from .pieces import op12_sentencepiece
from .pii import op3_pii
from .quality import op6_quality
from .search import ORACLE as SEARCH_SQL
from .search import op13_search
from .toxicity import op1_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_html": op4_html,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_lm": op8_lm,
    "op9_media": op9_media,
    "op10_jaccard": op10_jaccard,
    "op11_merkle": op11_merkle,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_search": op13_search,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op11_merkle": MERKLE_SQL, "op13_search": SEARCH_SQL}
