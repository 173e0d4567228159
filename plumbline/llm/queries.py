"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from plumbline.llm import (
    decontamination, embedding_dedup, fill_in_middle, line_dedup, lm_scoring, minhash_dedup, packing, quality, spelling, substring_dedup, top_k, toxicity, url_filter,
)
from plumbline.llm.common import table

QUERIES = {
    "op1_quality_classifier": lambda spark, sf_dir: quality.judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ).drop("f1"),
    "op2_lm_scoring": lambda spark, sf_dir: lm_scoring.score(table(spark, sf_dir, "documents")),
    "op3_line_dedup": lambda spark, sf_dir: line_dedup.digest(table(spark, sf_dir, "documents")),
    "op4_substring_dedup": lambda spark, sf_dir: substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")),
    "op5_benchmark_decontamination": lambda spark, sf_dir: decontamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ),
    "op9_url_filter": lambda spark, sf_dir: url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
    "op6_toxicity": lambda spark, sf_dir: toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_best_fit_packing": lambda spark, sf_dir: packing.pack_documents(table(spark, sf_dir, "documents")),
    "op8_embedding_near_dedup": lambda spark, sf_dir: embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")),
    "op10_minhash_near_dedup": lambda spark, sf_dir: minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")),
    "op11_exact_top_k": lambda spark, sf_dir: top_k.nearest(table(spark, sf_dir, "embeddings")),
    "op12_fill_in_middle": lambda spark, sf_dir: fill_in_middle.digest(table(spark, sf_dir, "documents")),
    "op13_spelling_variants": lambda spark, sf_dir: spelling.group_variants(table(spark, sf_dir, "documents")),
}
ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_benchmark_decontamination": decontamination.ORACLE,
    "op8_embedding_near_dedup": embedding_dedup.ORACLE,
    "op10_minhash_near_dedup": minhash_dedup.ORACLE,
    "op11_exact_top_k": top_k.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
