"""The registered queries opN_<name> of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.chat import OP5_SQL, op5_chat_formatting
from ridgeline.llm.decontam import OP9_SQL, op9_benchmark_decontamination
from ridgeline.llm.divergence import OP11_SQL, op11_source_divergence
from ridgeline.llm.frames import table
from ridgeline.llm.iblt import op8_document_fingerprints
from ridgeline.llm.jaccard import OP1_SQL, op1_ngram_jaccard_join
from ridgeline.llm.langid import op4_language_id
from ridgeline.llm.mincut import op13_html_extraction
from ridgeline.llm.mixing import OP10_SQL, op10_source_mixing
from ridgeline.llm.quality import op6_quality_classifier
from ridgeline.llm.secrets import op3_secret_scan
from ridgeline.llm.tokens import op2_token_counts
from ridgeline.llm.toxicity import op7_toxicity
from ridgeline.llm.whitening import op12_embedding_whitening


def _on(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": _on(op1_ngram_jaccard_join, "documents"),
        "op2_token_counts": _on(op2_token_counts, "documents"),
        "op3_secret_scan": _on(op3_secret_scan, "documents"),
        "op4_language_id": _on(op4_language_id, "documents"),
        "op5_chat_formatting": _on(op5_chat_formatting, "conversations"),
        "op6_quality_classifier": _on(op6_quality_classifier, "documents", "labels"),
        "op7_toxicity": _on(op7_toxicity, "documents", "labels"),
        "op8_document_fingerprints": _on(op8_document_fingerprints, "documents"),
        "op9_benchmark_decontamination": _on(op9_benchmark_decontamination, "documents", "benchmark"),
        "op10_source_mixing": _on(op10_source_mixing, "documents"),
        "op11_source_divergence": _on(op11_source_divergence, "documents"),
        "op12_embedding_whitening": _on(op12_embedding_whitening, "embeddings"),
        "op13_html_extraction": _on(op13_html_extraction, "pages"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op5_chat_formatting": OP5_SQL, "op9_benchmark_decontamination": OP9_SQL, "op10_source_mixing": OP10_SQL, "op11_source_divergence": OP11_SQL}
