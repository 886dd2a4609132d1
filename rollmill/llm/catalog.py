"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from rollmill.llm.classifier import op3_quality
from rollmill.llm.decontamination import op9_decontamination
from rollmill.llm.neardup import op6_near_dedup
from rollmill.llm.pieces import op2_pieces
from rollmill.llm.privacy import op7_pii
from rollmill.llm.resampling import op13_importance_resampling
from rollmill.llm.runs import op11_periodic_runs
from rollmill.llm.secrets import op8_secret_scan
from rollmill.llm.sharding import op1_sharding
from rollmill.llm.simhash import op10_simhash
from rollmill.llm.substrings import op5_substring_dedup
from rollmill.llm.toxicity import op12_toxicity
from rollmill.llm.warc import op4_warc

QUERIES = {f.__name__: f for f in (op1_sharding, op2_pieces, op3_quality, op4_warc, op5_substring_dedup, op6_near_dedup, op7_pii, op8_secret_scan, op9_decontamination, op10_simhash, op11_periodic_runs, op12_toxicity, op13_importance_resampling)}
ORACLES: dict[str, str] = {}
