"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard_join, license_rules, ngram_model, pseudonyms, quality_rules, quotes, repeats, sentence_pieces, token_counts


def queries() -> dict:
    return {
        "op1_quotes": quotes.query,
        "op2_token_counts": token_counts.query,
        "op3_pseudonyms": pseudonyms.query,
        "op4_quality_rules": quality_rules.query,
        "op5_license_rules": license_rules.query,
        "op6_ngram_model": ngram_model.query,
        "op7_decontaminate": decontaminate.query,
        "op8_repeats": repeats.query,
        "op9_jaccard_join": jaccard_join.query,
        "op10_sentence_pieces": sentence_pieces.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quotes": quotes.SQL,
        "op6_ngram_model": ngram_model.SQL,
        "op8_repeats": repeats.SQL,
        "op9_jaccard_join": jaccard_join.SQL,
    }
