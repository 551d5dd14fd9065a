"""DuckDB spellings of the key expressions, for the oracle SQL of several queries."""

from __future__ import annotations

from lexweave.functions import keys


def squeeze(c: str) -> str:
    return f"translate(regexp_replace({c}, '{keys.INVISIBLE}', '', 'g'), '．․。｡０１２３４５６７８９', '....0123456789')"


def section_id(c: str) -> str:
    return f"('§' || nullif(regexp_extract({squeeze(c)}, '{keys.SECTION}', 1), ''))"


def cited_title(c: str) -> str:
    s = squeeze(c)
    title, rest = f"regexp_extract({s}, '{keys.TITLE}(.*)$', 1)", f"regexp_extract({s}, '{keys.TITLE}(.*)$', 2)"
    part = f"regexp_extract({rest}, '^{keys.PART}', 1)"
    return f"(CASE WHEN {title} <> '' THEN CASE WHEN {part} <> '' THEN {title} || 'CFR part ' || {part} ELSE {title} || 'CFR ' || {section_id(rest)} END END)"
