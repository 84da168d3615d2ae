"""The queries of this package, by name, and the SQL that gives the same rows."""

from . import chat, conversations, decontaminate, language, lm, mixing, neardup, phrases, pivots, quality, sharding, toxicity, warc

_ALL = {
    "op1_decontamination": decontaminate,
    "op2_quality": quality,
    "op3_sharding": sharding,
    "op4_toxicity": toxicity,
    "op5_cross_entropy": lm,
    "op6_language": language,
    "op7_chat": chat,
    "op8_near_duplicates": neardup,
    "op9_mixing": mixing,
    "op10_warc": warc,
    "op11_pivot_search": pivots,
    "op12_phrases": phrases,
    "op13_conversation_repair": conversations,
}

QUERIES = {name: module.query for name, module in _ALL.items()}
SQL = {name: module.SQL for name, module in _ALL.items() if getattr(module, "SQL", None)}
