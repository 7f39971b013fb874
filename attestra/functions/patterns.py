"""Patterns in the dialect rules are written in: no look-around, no back-references, Unicode classes, $ at the end only."""

from __future__ import annotations

import re

from attestra.model import RuleError


def port(pattern: str) -> str:
    """The same pattern for Spark's regular expressions; an error where the dialect has no such construct."""
    bare = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?(?:=|!|<=|<!|>)", bare) or re.search(r"\\[1-9]", bare):
        raise RuleError(f"pattern with look-around or back-reference: {pattern}")
    if re.search(r"(?:[*+?]|\{\d+,?\d*\})\+", bare):
        raise RuleError(f"possessive pattern: {pattern}")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "(?U)" + "".join(out)


def full(pattern: str) -> str:
    return rf"(?U)\A(?:{port(pattern)[4:]})\z"
