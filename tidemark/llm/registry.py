"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import ann, embeddings, language, licenses, maxent, mixing, packing, quality, simhash, warc

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_pack": packing.op2_pack,
    "op3_language": language.op3_language,
    "op4_licenses": licenses.op4_licenses,
    "op5_ann": ann.op5_ann,
    "op6_mix": mixing.op6_mix,
    "op7_quality": quality.op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_lm": maxent.op9_lm,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op4_licenses": licenses.OP4_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
}
