"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from veilgraph.llm import chat, covertree, decontam, katz, langid, mixing, ordinal, sharding, simhash, substrings

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_shard": sharding.op2_shard,
    "op3_katz": katz.op3_katz,
    "op4_langid": langid.op4_langid,
    "op5_substrings": substrings.op5_substrings,
    "op6_chat": chat.op6_chat,
    "op7_topk": covertree.op7_topk,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": ordinal.op9_quality,
    "op10_decontaminate": decontam.op10_decontaminate,
}


def oracles() -> dict[str, str]:
    return {"op1_mix": mixing.ORACLE, "op2_shard": sharding.oracle(), "op5_substrings": substrings.ORACLE, "op6_chat": chat.ORACLE, "op7_topk": covertree.ORACLE, "op10_decontaminate": decontam.ORACLE}
