"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from plumbline.llm import (
    byte_cnn,
    cotraining,
    html_crf,
    mixing,
    piecewise,
    pii_crf,
    pivot_index,
    simhash,
    speculative_bpe,
    token_alignment,
    token_shards,
    vector_codes,
    warc,
)
from plumbline.llm.common import table

# The vocabulary files; callers may name others.
VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_mix_sources(spark, sf_dir):
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op2_cotrained_quality(spark, sf_dir):
    return cotraining.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_segments(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_speculative_bpe(spark, sf_dir, path=None):
    return speculative_bpe.token_digests(table(spark, sf_dir, "documents"), path or vocabulary())


def op5_token_shards(spark, sf_dir, path=None):
    return token_shards.shard_round_trip(table(spark, sf_dir, "documents"), path or vocabulary())


def op6_pivot_near_vectors(spark, sf_dir):
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_byte_cnn_language(spark, sf_dir):
    return byte_cnn.languages_of(table(spark, sf_dir, "documents"))


def op8_simhash_near_copies(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op9_html_main_text(spark, sf_dir):
    return html_crf.extracted(table(spark, sf_dir, "pages"))


def op10_piecewise_hashes(spark, sf_dir):
    return piecewise.near_edits(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_personal_data(spark, sf_dir):
    return pii_crf.personal_data(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir, byte_path=None, piece_path=None):
    return token_alignment.alignment(
        table(spark, sf_dir, "documents"),
        byte_path or public_tokenizers.path(BYTE_VOCABULARY), piece_path or public_tokenizers.path(PIECE_VOCABULARY),
    )


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_cotrained_quality": op2_cotrained_quality,
    "op3_warc_segments": op3_warc_segments,
    "op4_speculative_bpe": op4_speculative_bpe,
    "op5_token_shards": op5_token_shards,
    "op6_pivot_near_vectors": op6_pivot_near_vectors,
    "op7_byte_cnn_language": op7_byte_cnn_language,
    "op8_simhash_near_copies": op8_simhash_near_copies,
    "op9_html_main_text": op9_html_main_text,
    "op10_piecewise_hashes": op10_piecewise_hashes,
    "op11_vector_codes": op11_vector_codes,
    "op12_personal_data": op12_personal_data,
    "op13_token_alignment": op13_token_alignment,
}
SQL = {
    "op1_mix_sources": mixing.mix_sql(),
    "op3_warc_segments": warc.round_trip_sql(),
    "op6_pivot_near_vectors": pivot_index.vectors_sql(),
    "op11_vector_codes": vector_codes.codes_sql(),
}
