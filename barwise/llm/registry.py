"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from barwise.llm import chat, codes, decontaminate, fingerprint, html_text, langid, near_dedup, packing, quality, spelling, suffix_dedup, topk, toxicity

_MODULES = (packing, suffix_dedup, decontaminate, html_text, chat, near_dedup, fingerprint, toxicity, langid, quality, spelling, topk, codes)

QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= getattr(_m, "ORACLE", {})
