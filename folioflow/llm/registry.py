"""The queries of this folder, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, divergence, fill_in_middle, html_extraction, mixing, ngram_join, quality, sentencepiece_codec, substring_dedup, topk_search, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_chat": chat.op2_chat,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_warc": warc.op4_warc,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_ann": ann.op7_ann,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_mixing": mixing.op10_mixing,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL: dict[str, str] = {
    "op2_chat": chat.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_url_filters": url_filters.OP6_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op9_topk_search": topk_search.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_substring_dedup": substring_dedup.OP11_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
