"""Canonical spelling of section ids and cited titles, as Catalyst expressions.

The source data writes one id in many ways: blanks of several kinds, zero-width characters, a missing or
wrongly decoded section sign, the word "section", full-width dots, paragraph suffixes, closing punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of every kind, soft hyphens, zero-width characters and byte order marks; valid in Java and RE2.
INVISIBLE = r"[\s\x{000B}\x{0085}\x{00A0}\x{00AD}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+"
SECTION = r"^[^0-9A-Za-z]*(?:(?i:sections?|sec)[^0-9A-Za-z]*)?([0-9]{1,6}\.[0-9]{1,6})(?:\([0-9A-Za-z]{1,8}\))*[^0-9A-Za-z]*$"
TITLE = r"^[^0-9A-Za-z]*([0-9]{1,4})\.?(?i:c\.?f\.?r)\.?"
PART = r"(?i:part|pt)\.?([0-9]{1,6})[^0-9A-Za-z]*$"
_MARK = "\x01"


def squeeze(c: Column) -> Column:
    """c without blanks and invisible characters, with ASCII dots and digits."""
    return F.translate(F.regexp_replace(c, INVISIBLE, ""), "．․。｡０１２３４５６７８９", "....0123456789")


def section_id(c: Column) -> Column:
    """``§37.4`` for any readable spelling of that section, its paragraphs included; else null."""
    return F.concat(F.lit("§"), F.nullif(F.regexp_extract(squeeze(c), SECTION, 1), F.lit("")))


def cited_title(c: Column) -> Column:
    """``2CFR part 7`` or ``2CFR §7.12`` for any readable citation of another title; else null.

    Each rewriting names its input once, so that nothing is computed twice; a mark that no squeezed text has tells
    what was rewritten.
    """
    s = F.regexp_replace(F.translate(squeeze(c), _MARK, ""), TITLE + PART, f"{_MARK}$1CFR part $2")
    s = F.regexp_replace(s, TITLE + SECTION[1:], f"{_MARK}$1CFR §$2")
    return F.nullif(F.regexp_extract(s, f"^{_MARK}(.*)$", 1), F.lit(""))
