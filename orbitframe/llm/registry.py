"""The corpus queries by name, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm import audit, mixing, tries
from orbitframe.llm.audit import op11_audit
from orbitframe.llm.decontaminate import op3_decontaminate
from orbitframe.llm.fingerprints import op8_fingerprints
from orbitframe.llm.html import op2_html
from orbitframe.llm.licenses import op4_licenses
from orbitframe.llm.mixing import op6_mixing
from orbitframe.llm.neardup import op9_neardup
from orbitframe.llm.quality import op1_quality
from orbitframe.llm.scoring import op5_scoring
from orbitframe.llm.simhash import op13_simhash
from orbitframe.llm.substrings import op7_substrings
from orbitframe.llm.toxicity import op10_toxicity
from orbitframe.llm.tries import op12_trie

_QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_decontaminate": op3_decontaminate,
    "op4_licenses": op4_licenses,
    "op5_scoring": op5_scoring,
    "op6_mixing": op6_mixing,
    "op7_substrings": op7_substrings,
    "op8_fingerprints": op8_fingerprints,
    "op9_neardup": op9_neardup,
    "op10_toxicity": op10_toxicity,
    "op11_audit": op11_audit,
    "op12_trie": op12_trie,
    "op13_simhash": op13_simhash,
}

_SQL: dict[str, str] = {
    "op6_mixing": mixing.ORACLE,
    "op11_audit": audit.ORACLE,
    "op12_trie": tries.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
