"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import chat, embedding_dedup, html_text, lattice_lm, minhash_dedup, packing, quality, sharding, substring_dedup, word_bpe

QUERIES = {
    "op1_line_frequency": quality.op1_line_frequency,
    "op2_chat_format": chat.op2_chat_format,
    "op3_bm25_packing": packing.op3_bm25_packing,
    "op4_lattice_lm": lattice_lm.op4_lattice_lm,
    "op5_bottom_k_minhash": minhash_dedup.op5_bottom_k_minhash,
    "op6_rendezvous_sharding": sharding.op6_rendezvous_sharding,
    "op7_text_density": html_text.op7_text_density,
    "op8_prefix_bpe": word_bpe.op8_prefix_bpe,
    "op9_pca_tiled_dedup": embedding_dedup.op9_pca_tiled_dedup,
    "op10_fm_index_dedup": substring_dedup.op10_fm_index_dedup,
}
ORACLE_SQL = {
    "op1_line_frequency": quality.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op5_bottom_k_minhash": minhash_dedup.OP5_SQL,
    "op9_pca_tiled_dedup": embedding_dedup.OP9_SQL,
    "op10_fm_index_dedup": substring_dedup.OP10_SQL,
}
