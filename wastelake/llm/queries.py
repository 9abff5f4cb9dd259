"""Registered corpus queries and their SQL twins."""

from __future__ import annotations

from wastelake.llm import arrow_tokens, chat, exact_dedup, forest, mixing, packing, quality, secrets, simhash, spotsigs, toxicity, treap, variants
from wastelake.llm.common import table

QUERIES = {
    "op1_best_fit_packing": lambda spark, sf: packing.op1(table(spark, sf, "documents")),
    "op2_toxicity": lambda spark, sf: toxicity.op2(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op3_spot_signatures": lambda spark, sf: spotsigs.op3(table(spark, sf, "documents")),
    "op4_mix_sources": lambda spark, sf: mixing.op4(table(spark, sf, "documents")),
    "op5_arrow_tokens": lambda spark, sf: arrow_tokens.op5(table(spark, sf, "documents")),
    "op6_quality": lambda spark, sf: quality.op6(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op7_perspectives": lambda spark, sf: chat.op7(table(spark, sf, "conversations")),
    "op8_secret_scan": lambda spark, sf: secrets.op8(table(spark, sf, "documents")),
    "op9_simhash_groups": lambda spark, sf: simhash.op9(table(spark, sf, "documents")),
    "op10_exact_dedup": lambda spark, sf: exact_dedup.op10(table(spark, sf, "documents")),
    "op11_spelling_variants": lambda spark, sf: variants.op11(table(spark, sf, "documents")),
    "op12_forest_groups": lambda spark, sf: forest.op12(table(spark, sf, "documents")),
    "op13_treap_search": lambda spark, sf: treap.op13(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
}
ORACLES = {"op4_mix_sources": mixing.ORACLE, "op7_perspectives": chat.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op13_treap_search": treap.ORACLE}
