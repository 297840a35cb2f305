"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import importlib

#: module: query function; a module's ORACLE is the twin, where SQL can express the query.
_OPERATORS = {
    "url_filter": "op1_url_filter",
    "template_decontam": "op3_template_decontam",
    "perspectives": "op4_chat_perspectives",
    "quality_model": "op2_quality_scores",
    "jaccard_tree": "op5_jaccard_join",
    "rule_cascade": "op6_rule_cascade",
    "notice_search": "op7_license_notices",
    "token_shards": "op8_token_shards",
    "suffix_dedup": "op9_suffix_dedup",
    "fair_mix": "op10_fair_mix",
    "external_shuffle": "op11_external_shuffle",
    "whitening": "op12_embedding_whitening",
    "prefix_trie": "op13_prefix_trie",
}


def _load() -> tuple[dict, dict]:
    queries, twins = {}, {}
    for module, name in _OPERATORS.items():
        m = importlib.import_module(f"quiver.llm.{module}")
        queries[name] = getattr(m, name)
        if getattr(m, "ORACLE", None):
            twins[name] = m.ORACLE
    return queries, twins


QUERIES, ORACLE = _load()
