"""Queries of the operators: name to (query, SQL or None)."""

from __future__ import annotations

from scribeloom.llm import (
    bm25, html_text, jaccard_join, line_dedup, long_repeats, mixing, pieces, quality, secrets, token_files, url_filter,
    vector_clusters, vector_codes,
)
from scribeloom.llm.common import table


def tokenizer_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark, folder):
    return html_text.op1(table(spark, folder, "pages"))


def op2_run_length_dedup(spark, folder):
    return long_repeats.op2(table(spark, folder, "documents"))


def op3_quality_rules(spark, folder):
    return quality.op3(table(spark, folder, "documents"))


def op4_token_files(spark, folder):
    return token_files.op4(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_mixing(spark, folder):
    return mixing.op5(table(spark, folder, "documents"))


def op6_exact_search(spark, folder):
    return bm25.op6(table(spark, folder, "documents"))


def op7_secret_scan(spark, folder):
    return secrets.op7(table(spark, folder, "documents"))


def op8_url_filters(spark, folder):
    return url_filter.op8(table(spark, folder, "pages"), table(spark, folder, "events"))


def op9_sentencepiece(spark, folder):
    return pieces.op9(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_jaccard_join(spark, folder):
    return jaccard_join.op10(table(spark, folder, "documents"))


def op11_line_dedup(spark, folder):
    return line_dedup.op11(table(spark, folder, "documents"))


def op12_vector_codes(spark, folder):
    return vector_codes.op12(table(spark, folder, "embeddings"))


def op13_vector_clusters(spark, folder):
    return vector_clusters.op13(table(spark, folder, "embeddings"))


ALL = {
    "op1_html_extraction": (op1_html_extraction, None),
    "op2_run_length_dedup": (op2_run_length_dedup, None),
    "op3_quality_rules": (op3_quality_rules, quality.OP3_SQL),
    "op4_token_files": (op4_token_files, None),
    "op5_mixing": (op5_mixing, mixing.OP5_SQL),
    "op6_exact_search": (op6_exact_search, None),
    "op7_secret_scan": (op7_secret_scan, None),
    "op8_url_filters": (op8_url_filters, url_filter.OP8_SQL),
    "op9_sentencepiece": (op9_sentencepiece, None),
    "op10_jaccard_join": (op10_jaccard_join, jaccard_join.OP10_SQL),
    "op11_line_dedup": (op11_line_dedup, line_dedup.OP11_SQL),
    "op12_vector_codes": (op12_vector_codes, vector_codes.OP12_SQL),
    "op13_vector_clusters": (op13_vector_clusters, vector_clusters.OP13_SQL),
}
