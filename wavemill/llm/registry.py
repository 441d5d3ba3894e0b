"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, decontamination, exact_dedup, fill_middle, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash, substring_dedup, target_sampling

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_simhash": simhash.op2_simhash,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_pii": pii.op4_pii,
    "op5_quality": quality_classifier.op5_quality,
    "op6_chat": chat.op6_chat,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_target_sampling": target_sampling.op11_target_sampling,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLE_SQL = {
    "op6_chat": chat.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op11_target_sampling": target_sampling.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
