"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from . import collocations, exact_dedup, jaccard, knn, language, licenses, mixing, packing, quality, repeats, runs, secrets, threads

QUERIES: dict[str, Callable] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language.op4_language_id,
    "op5_exact_top_k": knn.op5_exact_top_k,
    "op6_quality": quality.op6_quality,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_quotation_linking": threads.op8_quotation_linking,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_collocations": collocations.op12_collocations,
    "op13_substring_dedup": repeats.op13_substring_dedup,
}

SQL: dict[str, str] = {"op5_exact_top_k": knn.OP5_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL, "op12_collocations": collocations.OP12_SQL, "op13_substring_dedup": repeats.OP13_SQL}
