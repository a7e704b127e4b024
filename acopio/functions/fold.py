"""Folding of names: exact match keys and search keys, inside codegen."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _marked() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition begins with a to z, and that letter: the rule
    behind the match key, worked out for the blocks that have any (none lie beyond U+3000)."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x80, 0x3000) if chr(c) == chr(c).lower()]
    found = [(a, b) for a, b in found if "a" <= b <= "z"]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def name_fold(c: Column | str) -> Column:
    """SF9: lower case, decomposed, only a-z and 0-9 kept; null where nothing is left.

    What decomposes to a letter is translated; marks and all else go with the pattern, as they would after
    decomposition.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.translate(F.lower(c), *_marked()), "[^a-z0-9]+", ""), F.lit(""))


def contains_folded(c: Column, query: str) -> Column:
    """FIL12, FIL13: substring without case or accents; a blank query matches all."""
    q = query.strip()
    return F.lit(True) if not q else F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(q), "UNICODE_CI_AI"))
