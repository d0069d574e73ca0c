"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontaminate, exact, licenses, lines, maxent, mixing, negatives, quality, sharding, simhash, substrings, urls, vectorcodes

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_licenses": licenses.op2_licenses,
    "op3_urls": urls.op3_urls,
    "op4_substrings": substrings.op4_substrings,
    "op5_lines": lines.op5_lines,
    "op6_quality": quality.op6_quality,
    "op7_simhash": simhash.op7_simhash,
    "op8_sharding": sharding.op8_sharding,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_maxent": maxent.op10_maxent,
    "op11_codes": vectorcodes.op11_codes,
    "op12_exact": exact.op12_exact,
    "op13_negatives": negatives.op13_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op3_urls": urls.ORACLE, "op4_substrings": substrings.ORACLE, "op6_quality": quality.ORACLE, "op9_decontaminate": decontaminate.ORACLE, "op11_codes": vectorcodes.ORACLE, "op12_exact": exact.ORACLE, "op13_negatives": negatives.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
