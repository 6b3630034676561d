"""The queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from . import decontam, langid, linededup, minhash, mixing, quality, repeats, simple8b, toxicity, warc

QUERIES = {
    "op8_repeats": repeats.query,
    "op3_warc": warc.query,
    "op5_quality": quality.query,
    "op4_toxicity": toxicity.query,
    "op1_mixing": mixing.query,
    "op9_decontamination": decontam.query,
    "op10_token_binary": simple8b.query,
    "op6_line_dedup": linededup.query,
    "op2_minhash_groups": minhash.query,
    "op7_language_id": langid.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op6_line_dedup": linededup.SQL,
}
