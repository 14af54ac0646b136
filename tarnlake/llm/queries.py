"""The registered queries of this part and the SQL that some of them equal."""

from __future__ import annotations

from tarnlake.llm import bpe, ctw, hnsw, lattice, mixing, neardup, quality, secrets, substring, urlrules

QUERIES = {
    "op1_ctw": ctw.op1,
    "op2_hnsw": hnsw.op2,
    "op3_source_mixing": mixing.op3,
    "op4_lattice_neardup": lattice.op4,
    "op5_minhash_tensored": neardup.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_substring_dedup": substring.op7,
    "op8_quality_gam": quality.op8,
    "op9_secret_scan": secrets.op9,
    "op10_url_rules": urlrules.op10,
}
ORACLES = {
    "op2_hnsw": hnsw.ORACLE,
    "op4_lattice_neardup": lattice.ORACLE,
    "op5_minhash_tensored": neardup.ORACLE,
    "op7_substring_dedup": substring.ORACLE,
    "op9_secret_scan": secrets.ORACLE,
    "op10_url_rules": urlrules.ORACLE,
}
