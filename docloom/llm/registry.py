"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from docloom.llm import embedding_dedup, html_text, line_dedup, mixing, neighbours, packing, prefix_trie, quality_model, quality_rules, simhash, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_warc": warc.op2_warc,
        "op3_html_text": html_text.op3_html_text,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_simhash": simhash.op5_simhash,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_classifier": quality_model.op7_quality_classifier,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_packing": packing.op9_packing,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
        "op12_whitening": whitening.op12_whitening,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op2_warc": warc.OP2_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op10_embedding_dedup": embedding_dedup.OP10_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
