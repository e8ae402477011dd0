"""Queries and SQL of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from strandline.llm import jaccard_join, lattice_dedup, mixing, packing, quality_model, quality_rules, sharding, token_files, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        quality_model.op2_quality_classifier,
        quality_rules.op3_quality_rules,
        mixing.op4_mixing,
        token_files.op5_token_files,
        lattice_dedup.op6_lattice_dedup,
        url_filter.op7_url_filter,
        jaccard_join.op8_ngram_jaccard_join,
        sharding.op9_sharding,
        toxicity.op10_toxicity,
    )
}
SQL = {"op4_mixing": mixing.OP4_SQL, "op6_lattice_dedup": lattice_dedup.OP6_SQL, "op7_url_filter": url_filter.OP7_SQL, "op8_ngram_jaccard_join": jaccard_join.OP8_SQL}
