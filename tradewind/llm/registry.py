"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tradewind.llm import brown, decontaminate, host_rules, langid, merkle, mixing, neighbours, pii, reshard, simhash, tokens, toxicity, variants


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_mixing": mixing.op3_mixing,
        "op4_langid": langid.op4_langid,
        "op5_tokens": tokens.op5_tokens,
        "op6_simhash": simhash.op6_simhash,
        "op7_host_rules": host_rules.op7_host_rules,
        "op8_reshard": reshard.op8_reshard,
        "op9_pii": pii.op9_pii,
        "op10_brown": brown.op10_brown,
        "op11_variants": variants.op11_variants,
        "op12_merkle": merkle.op12_merkle,
        "op13_quality": neighbours.op13_quality,
    }


def oracle_sql() -> dict:
    return {"op11_variants": variants.SQL, "op12_merkle": merkle.SQL}
