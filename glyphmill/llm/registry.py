"""Queries of this subpackage, by name, and SQL that gives the same rows."""

from __future__ import annotations

from glyphmill.llm.digest import op8_quartile_digest
from glyphmill.llm.histogram import op13_planned_pack
from glyphmill.llm.langid import op6_language_crf
from glyphmill.llm.lloyd import OP12_SQL, op12_lloyd
from glyphmill.llm.media import op2_webp_lossless
from glyphmill.llm.mixing import OP4_SQL, op4_mix
from glyphmill.llm.negatives import OP11_SQL, op11_hard_negatives
from glyphmill.llm.packing import op10_pack
from glyphmill.llm.pii import op1_pii_weak_supervision
from glyphmill.llm.quality import op3_quality_qda
from glyphmill.llm.simhash import op9_simhash_dedup
from glyphmill.llm.toxicity import op5_toxicity_viterbi
from glyphmill.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_webp_lossless": op2_webp_lossless,
    "op3_quality_qda": op3_quality_qda,
    "op4_mix": op4_mix,
    "op5_toxicity_viterbi": op5_toxicity_viterbi,
    "op6_language_crf": op6_language_crf,
    "op7_warc": op7_warc,
    "op8_quartile_digest": op8_quartile_digest,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_pack": op10_pack,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lloyd": op12_lloyd,
    "op13_planned_pack": op13_planned_pack,
}
ORACLE_SQL: dict[str, str] = {"op4_mix": OP4_SQL, "op7_warc": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_lloyd": OP12_SQL}
