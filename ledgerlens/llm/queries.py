"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, embed_dedup, fim, html_text, mixing, neardup, quality, ring, surrogates, token_counts, token_store, trie, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_token_store": token_store.op3_token_store,
        "op4_warc": warc.op4_warc,
        "op5_pii_surrogates": surrogates.op5_pii_surrogates,
        "op6_html_text": html_text.op6_html_text,
        "op7_quality": quality.op7_quality,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_mixing": mixing.op9_mixing,
        "op10_embedding_near_dedup": embed_dedup.op10_embedding_near_dedup,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_ring_shards": ring.op12_ring_shards,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.OP4_SQL, "op9_mixing": mixing.OP9_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op12_ring_shards": ring.OP12_SQL, "op13_prefix_trie": trie.OP13_SQL}
