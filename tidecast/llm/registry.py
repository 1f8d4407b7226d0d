"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from tidecast.llm import bpe, chat, decontaminate, jaccard, langid, licenses, lloyd, neardup, negatives, pii, quality, repeats, warc


def queries() -> dict:
    every = [
        neardup.op1_embedding_near_dedup, chat.op2_chat_format, licenses.op3_license_scan, repeats.op4_suffix_array_dedup, jaccard.op5_ngram_jaccard_join,
        bpe.op6_byte_level_bpe, decontaminate.op7_decontamination, pii.op8_pii, langid.op9_language_id, warc.op10_warc,
        negatives.op11_hard_negatives, lloyd.op12_vector_code_compression, quality.op13_quality_classifier,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": neardup.OP1_SQL, "op2_chat_format": chat.OP2_SQL, "op5_ngram_jaccard_join": jaccard.OP5_SQL, "op10_warc": warc.OP10_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_vector_code_compression": lloyd.op12_sql()}
