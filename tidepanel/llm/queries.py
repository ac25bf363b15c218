"""The registered query of each operator, and SQL answers where SQL can express one."""
from __future__ import annotations

from . import decontaminate, embeddings, language, lines, mixing, pii, sharding, simhash, sketches, spelling, tokens, toxicity, trie

QUERIES = {f.__name__: f for f in (
    simhash.op1_simhash_neardup, lines.op2_line_dedup, pii.op3_pii, toxicity.op4_toxicity, tokens.op5_token_counts, decontaminate.op6_decontamination, sharding.op7_sharding,
    mixing.op8_mixing, language.op9_language_id, sketches.op10_fingerprints,
    embeddings.op11_embedding_neardup, spelling.op12_spelling, trie.op13_conversation_trie)}
ORACLES = {"op8_mixing": mixing.ORACLE}
