"""The queries of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .byte_bpe import op11_byte_bpe
from .centroids import CENTROIDS_SQL, op12_centroids
from .fingerprints import op5_fingerprints
from .jaccard import JACCARD_SQL, op6_jaccard
from .language import op2_language
from .mixing import op1_mixing
from .neighbours import op8_neighbours
from .packing import op9_packing
from .secrets import SECRETS_SQL, op7_secrets
from .substrings import op10_substrings
from .toxicity import op4_toxicity
from .warc import WARC_SQL, op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_language": op2_language,
        "op3_warc": op3_warc,
        "op4_toxicity": op4_toxicity,
        "op5_fingerprints": op5_fingerprints,
        "op6_jaccard": op6_jaccard,
        "op7_secrets": op7_secrets,
        "op8_neighbours": op8_neighbours,
        "op9_packing": op9_packing,
        "op10_substrings": op10_substrings,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_centroids": op12_centroids,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": WARC_SQL,
        "op6_jaccard": JACCARD_SQL,
        "op7_secrets": SECRETS_SQL,
        "op12_centroids": CENTROIDS_SQL,
    }
