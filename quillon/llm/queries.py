"""The contract queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, decontaminate, lines, mixing, pii, quality, sharding, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_sharding": sharding.op4_sharding,
    "op5_lines": lines.op5_lines,
    "op6_pii": pii.op6_pii,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat": chat.op8_chat,
    "op9_ann": ann.op9_ann,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op4_sharding": sharding.SQL,
    "op5_lines": lines.SQL,
    "op8_chat": chat.SQL,
    "op9_ann": ann.SQL,
    "op10_mixing": mixing.SQL,
}
