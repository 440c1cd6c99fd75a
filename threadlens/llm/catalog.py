"""The registered queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import (convrepair, decontam, licenses, linededup, maxent, packing, secret_scan, sharding, simhash, spelling,
               toxicity, urlrules, vecjoin)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_packing": packing.op4_packing,
    "op5_lm_score": maxent.op5_lm_score,
    "op6_url_filter": urlrules.op6_url_filter,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_embedding_dedup": vecjoin.op8_embedding_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_conversation_repair": convrepair.op13_conversation_repair,
}

ORACLE = {
    "op3_license_scan": licenses.ORACLE,
    "op6_url_filter": urlrules.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op8_embedding_dedup": vecjoin.ORACLE,
    "op11_line_dedup": linededup.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_conversation_repair": convrepair.ORACLE,
}
