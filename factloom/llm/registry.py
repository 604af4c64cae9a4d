"""The subpackage's queries and the SQL that some of them can be checked with."""

from __future__ import annotations

from . import ann, bpe, embedding_dups, html_text, near_dups, packing, quality, sharding, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_near_dups": near_dups.query,
    "op3_url_filter": urls.query,
    "op4_nearest": ann.query,
    "op5_packing": packing.query,
    "op6_sharding": sharding.query,
    "op7_html_text": html_text.query,
    "op8_embedding_dups": embedding_dups.query,
    "op9_bpe": bpe.query,
    "op10_quality": quality.query,
}

ORACLE_SQL = {"op2_near_dups": near_dups.oracle(3, 85), "op3_url_filter": urls.ORACLE_SQL}
