"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidegrid.llm.decontamination import OP10_SQL, op10_benchmark_decontamination
from tidegrid.llm.langid import op3_language_id
from tidegrid.llm.negatives import OP11_SQL, op11_hard_negatives
from tidegrid.llm.packing import op7_best_fit_packing
from tidegrid.llm.pii import op8_pii_candidates
from tidegrid.llm.ppm import op6_ppm_scoring
from tidegrid.llm.quality import OP5_SQL, op5_quality_rules
from tidegrid.llm.repeats import op1_suffix_array_dedup
from tidegrid.llm.secrets import op9_secret_scan
from tidegrid.llm.simhash import op4_simhash_near_dedup
from tidegrid.llm.toxicity import op12_toxicity
from tidegrid.llm.warc import OP2_SQL, op2_warc_round_trip
from tidegrid.llm.whitening import op13_embedding_whitening


def queries() -> dict:
    return {
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op8_pii_candidates": op8_pii_candidates,
        "op2_warc_round_trip": op2_warc_round_trip,
        "op9_secret_scan": op9_secret_scan,
        "op3_language_id": op3_language_id,
        "op6_ppm_scoring": op6_ppm_scoring,
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_toxicity": op12_toxicity,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_round_trip": OP2_SQL, "op5_quality_rules": OP5_SQL, "op10_benchmark_decontamination": OP10_SQL, "op11_hard_negatives": OP11_SQL}
