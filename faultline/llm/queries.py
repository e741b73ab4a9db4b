"""Every query of this subpackage, with SQL where SQL can express it."""

from . import q_bpe, q_exact, q_language, q_maxent, q_mixing, q_near, q_preference, q_search, q_toxicity, q_warc

_MODULES = [q_maxent, q_near, q_language, q_warc, q_toxicity, q_preference, q_search, q_exact, q_mixing, q_bpe]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
