"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontamination, hard_negatives, jaccard_join, line_crf, line_dedup, ordinal_classifier, packing, paragraph_minhash, prefix_trie, skip_chain_pii, source_mixing, suffix_tree_lm, warc

_MODULES = (paragraph_minhash, suffix_tree_lm, skip_chain_pii, ordinal_classifier, warc, decontamination, source_mixing, line_crf, jaccard_join, line_dedup, hard_negatives, prefix_trie, packing)

QUERIES = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
ORACLES = {name: m.ORACLE_SQL for m in _MODULES for name in vars(m) if name in QUERIES and getattr(m, "ORACLE_SQL", None)}
