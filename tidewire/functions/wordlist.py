"""One pass over a text for every whole-word term of the rules.

Rules are long word lists. Instead of running each over the whole text, one prefix-tree pattern
collects the terms that occur (the longest at every word start, overlaps included); the rules then
read that short digest. A whole-word rule holds on the digest exactly when it holds on the text.
"""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import Column, functions as F

from ..rules import lexicon as L
from .text import col


def expand(term: str) -> list[str]:
    """Plain words of a term with character classes and optional letters."""
    parts = []
    for cls, opt, plain in re.findall(r"\[([a-z]+)\](\??)|([a-z0-9 -]\??)", term):
        choices = list(cls) if cls else [plain[0]]
        if opt or plain.endswith("?"):
            choices = choices + [""]
        parts.append(choices)
    return ["".join(p) for p in itertools.product(*parts)]


def rule_terms(rules) -> list[str]:
    out = []
    for _, pattern in rules:
        inner = pattern.removeprefix(r"\b(?:").removesuffix(r")\b")
        out += [w for t in inner.split("|") for w in expand(t)]
    return out


def tree_pattern(terms) -> str:
    """Alternation of the terms with shared prefixes, longer continuations first."""
    root: dict = {}
    for t in terms:
        node = root
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def write(node) -> str:
        ends = "" in node
        branches = [re.escape(ch) + write(sub) for ch, sub in sorted(node.items()) if ch != ""]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
        # Greedy, so the longest term at a word start wins; shorter ones are its prefix.
        return body + "?" if ends else body

    return write(root)


@functools.lru_cache(maxsize=1)
def all_terms_pattern() -> str:
    from .facts import local_terms, place_terms
    terms = rule_terms(L.INCIDENT_RULES + L.EARLY_RULES + L.TOPIC_RULES + L.VEHICLE_RULES + L.SEVERITY_WORDS)
    terms += [t for t, _ in L.RELEVANCE] + [t[0] for t in place_terms()] + local_terms()
    terms += L.OTHER_ISLANDS + L.MAINLAND_CITIES + L.EVENT_PHRASES
    return rf"(?<![a-z0-9])(?=({tree_pattern(dict.fromkeys(terms))})(?![a-z0-9]))"


def digest(normalized) -> Column:
    """Terms found in normalised text, blank padded and kept apart: `` | term | other term | ``."""
    hits = F.array_distinct(F.regexp_extract_all(col(normalized), F.lit(all_terms_pattern()), F.lit(1)))
    return F.concat(F.lit(" | "), F.array_join(hits, " | "), F.lit(" | "))
