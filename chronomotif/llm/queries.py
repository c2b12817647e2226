"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronomotif.llm import centroids, chats, filter_audit, mixing, ngram_join, secrets
from chronomotif.llm.centroids import op13_centroids
from chronomotif.llm.chats import op8_chat_formatting
from chronomotif.llm.filter_audit import op12_filter_audit
from chronomotif.llm.fingerprints import op10_fingerprints
from chronomotif.llm.media import op9_media
from chronomotif.llm.mixing import op4_mixing
from chronomotif.llm.ngram_join import op3_ngram_join
from chronomotif.llm.packing import op11_best_fit_packing
from chronomotif.llm.pieces import op1_sentencepiece
from chronomotif.llm.quality import op6_quality
from chronomotif.llm.secrets import op2_secrets
from chronomotif.llm.token_counts import op7_token_counts
from chronomotif.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_secrets": op2_secrets,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_media": op9_media,
    "op10_fingerprints": op10_fingerprints,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secrets": secrets.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op4_mixing": mixing.SQL,
    "op8_chat_formatting": chats.SQL,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_filter_audit": filter_audit.SQL,
    "op13_centroids": centroids.SQL,
}
