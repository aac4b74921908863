"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tempora.llm import bpe, collocations, exact_dedup, line_dedup, media, packing, pii, secret_scan, sharding, simhash, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_bpe_codec": bpe.op1,
    "op2_segment_tree_counts": token_counts.op2,
    "op3_streaming_exact_dedup": exact_dedup.op3,
    "op4_minimum_slack_packing": packing.op4,
    "op5_media_members": media.op5,
    "op6_simhash_tiles": simhash.op6,
    "op7_boosted_toxicity": toxicity.op7,
    "op8_offset_pii": pii.op8,
    "op9_rendezvous_sharding": sharding.op9,
    "op10_template_line_dedup": line_dedup.op10,
    "op11_suffix_sigma_collocations": collocations.op11,
    "op12_hamerly_codes": vector_codes.op12,
    "op13_assignment_secrets": secret_scan.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op3_streaming_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)
    """,
    "op9_rendezvous_sharding": sharding.ORACLE_SQL,
    "op10_template_line_dedup": line_dedup.ORACLE_SQL,
    "op11_suffix_sigma_collocations": collocations.ORACLE_SQL,
    "op12_hamerly_codes": vector_codes.ORACLE_SQL,
}
