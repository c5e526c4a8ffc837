"""Queries of the training-corpus operators, one per operator."""

from __future__ import annotations

from quern.llm import merkle, rules, trie
from quern.llm.ann import op9_collision_counting
from quern.llm.binary import op5_pfor_tokens
from quern.llm.decontaminate import op8_template_decontamination
from quern.llm.langid import op2_language_id
from quern.llm.licenses import op4_license_scan
from quern.llm.merkle import op11_merkle_manifest
from quern.llm.near_dedup import op10_near_dedup
from quern.llm.packing import op3_best_fit_packing
from quern.llm.quality import op1_quality_classifier
from quern.llm.rules import op13_rule_ledger
from quern.llm.sharding import op7_sampled_splitters
from quern.llm.substring_dedup import op6_substring_dedup
from quern.llm.trie import op12_conversation_trie

_QUERIES = (
    op1_quality_classifier,
    op2_language_id,
    op3_best_fit_packing,
    op4_license_scan,
    op5_pfor_tokens,
    op6_substring_dedup,
    op7_sampled_splitters,
    op8_template_decontamination,
    op9_collision_counting,
    op10_near_dedup,
    op11_merkle_manifest,
    op12_conversation_trie,
    op13_rule_ledger,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the tests of the others use brute force."""
    return {"op11_merkle_manifest": merkle.ORACLE_SQL, "op12_conversation_trie": trie.ORACLE_SQL, "op13_rule_ledger": rules.ORACLE_SQL}
