"""The queries of this subpackage and the SQL of those that SQL can express."""

from gneiss.llm import bpe, exact_dedup, minhash, mixing, neighbours, pii, repair, sharding, substrings, token_files, topk, toxicity, vector_codes

_MODULES = (pii, sharding, toxicity, neighbours, minhash, exact_dedup, bpe, mixing, token_files, substrings, topk, vector_codes, repair)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
