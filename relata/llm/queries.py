"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from relata.llm import chat_format, decontamination, fill_in_middle, hnsw, language_id, periodic_runs, piece_encoding, pii_surrogates, quality_fm
from relata.llm import simhash_dedup, source_mixing, url_rules, warc_index

QUERIES = {
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op3_source_mixing": source_mixing.op3_source_mixing,
    "op8_url_rules": url_rules.op8_url_rules,
    "op1_language_id": language_id.op1_language_id,
    "op6_quality_fm": quality_fm.op6_quality_fm,
    "op2_warc_index": warc_index.op2_warc_index,
    "op9_pii_surrogates": pii_surrogates.op9_pii_surrogates,
    "op10_hnsw": hnsw.op10_hnsw,
    "op7_chat_format": chat_format.op7_chat_format,
    "op4_decontaminate": decontamination.op4_decontaminate,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_piece_encoding": piece_encoding.op13_piece_encoding,
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_format": chat_format.ORACLE,
    "op10_hnsw": hnsw.ORACLE,
    "op2_warc_index": warc_index.ORACLE,
    "op8_url_rules": url_rules.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
