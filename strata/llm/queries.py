"""The numbered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.llm import chat, fill_middle, urls, warc
from strata.llm.base import ORACLES, QUERIES, query, table
from strata.llm.language import held_out, identify, train
from strata.llm.near_text import near_duplicates
from strata.llm.near_vectors import near_vectors
from strata.llm.overlap import decontaminated
from strata.llm.packing import pack_documents
from strata.llm.private_spans import private_spans
from strata.llm.pseudo_likelihood import pseudo_likelihood
from strata.llm.token_files import read_tokens, write_tokens
from strata.llm.whitening import whiten

__all__ = ["ORACLES", "QUERIES"]


@query("op6_minmax_near_dedup")
def _near_text(spark, folder, scratch):
    return near_duplicates(table(spark, folder, "documents"), scratch)


@query("op2_packed_token_files")
def _token_files(spark, folder, scratch):
    return read_tokens(write_tokens(table(spark, folder, "documents"), scratch))


@query("op5_histogram_packing")
def _packing(spark, folder, scratch):
    return pack_documents(table(spark, folder, "documents"), scratch)


@query("op7_winnowing_decontamination")
def _overlap(spark, folder, scratch):
    return decontaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), scratch)


@query("op8_url_rules", urls.SQL)
def _urls(spark, folder, scratch):
    return urls.judge(table(spark, folder, "pages").select("page_id", "url")).drop("url")


@query("op10_language_families")
def _language(spark, folder, scratch):
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text"))
    return identify(rows, train(docs), drop=("text",))


@query("op1_cross_polytope_near_dedup")
def _near_vectors(spark, folder, scratch):
    return near_vectors(table(spark, folder, "embeddings"), scratch)


@query("op4_merkle_fixity_audit", warc.SQL)
def _fixity(spark, folder, scratch):
    return warc.fixity(table(spark, folder, "pages"), scratch).select("page_id", "length", "status")


@query("op9_masked_pseudo_likelihood")
def _pseudo_likelihood(spark, folder, scratch):
    return pseudo_likelihood(table(spark, folder, "documents"), scratch)


@query("op3_semi_markov_private_spans")
def _private(spark, folder, scratch):
    return private_spans(table(spark, folder, "documents"))


@query("op11_spectrum_sliced_whitening")
def _whitening(spark, folder, scratch):
    return whiten(table(spark, folder, "embeddings"), scratch)


@query("op12_event_sourced_chat", chat.SQL)
def _chat(spark, folder, scratch):
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_log(chat.as_log(rows), scratch))


@query("op13_wavelet_fill_in_middle", fill_middle.SQL)
def _fill_middle(spark, folder, scratch):
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
