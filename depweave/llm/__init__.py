"""Operators for preparing training data, each with its query and SQL."""

from . import ann, chat_format, exact_dedup, language_id, lm_scoring, mixing, near_dedup, sharding, tokenization, warc

_MODULES = (exact_dedup, chat_format, language_id, sharding, warc, tokenization, mixing, ann, near_dedup, lm_scoring)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
