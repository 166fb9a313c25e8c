"""The queries of the training-data operators, and SQL twins where SQL can say the same."""

from __future__ import annotations

from ruleloom.llm.ann import op12_ann_cross_polytope
from ruleloom.llm.decontaminate import op8_benchmark_decontamination
from ruleloom.llm.language import op2_language_id
from ruleloom.llm.licenses import op4_license_scan
from ruleloom.llm.near import op6_ngram_jaccard_join
from ruleloom.llm.packing import op3_best_fit_packing
from ruleloom.llm.pii import op1_pii_surrogates
from ruleloom.llm.resampling import OP13_SQL, op13_importance_resampling
from ruleloom.llm.substrings import op9_suffix_array_dedup
from ruleloom.llm.topk import OP5_SQL, op5_exact_topk
from ruleloom.llm.toxicity import op10_toxicity
from ruleloom.llm.warc import OP7_SQL, op7_warc_normalise
from ruleloom.llm.whitening import op11_embedding_whitening

QUERIES = [op1_pii_surrogates, op2_language_id, op3_best_fit_packing, op4_license_scan, op5_exact_topk, op6_ngram_jaccard_join, op7_warc_normalise, op8_benchmark_decontamination, op9_suffix_array_dedup, op10_toxicity, op11_embedding_whitening, op12_ann_cross_polytope, op13_importance_resampling]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op5_exact_topk": OP5_SQL, "op7_warc_normalise": OP7_SQL, "op13_importance_resampling": OP13_SQL}
