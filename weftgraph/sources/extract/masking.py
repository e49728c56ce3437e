"""Blanks comments and strings out of source text, so that patterns and braces can be trusted."""

from __future__ import annotations

import re
from functools import cache

# How comments and strings are spelled: line comments, block comments, quotes of strings.
_C = (("//",), (("/*", "*/"),), ('"',))
STYLES = {
    "rust": (("//",), (("/*", "*/"),), ('"',)),
    "javascript": (("//",), (("/*", "*/"),), ('"', "'", "`")),
    "typescript": (("//",), (("/*", "*/"),), ('"', "'", "`")),
    "go": (("//",), (("/*", "*/"),), ('"', "`", "'")),
    "java": (("//",), (("/*", "*/"),), ('"""', '"', "'")),
    "c": _C,
    "cpp": _C,
    "csharp": (("//",), (("/*", "*/"),), ('"',)),
    "php": (("//", "#"), (("/*", "*/"),), ('"', "'")),
    "swift": (("//",), (("/*", "*/"),), ('"""', '"')),
    "kotlin": (("//",), (("/*", "*/"),), ('"""', '"', "'")),
    "dart": (("//",), (("/*", "*/"),), ('"""', "'''", '"', "'")),
    "ruby": (("#",), (("=begin", "=end"),), ('"', "'")),
    "python": (("#",), (), ('"""', "'''", '"', "'")),
    "elisp": ((";",), (), ('"',)),
    "commonlisp": ((";",), (("#|", "|#"),), ('"',)),
    "scheme": ((";",), (("#|", "|#"),), ('"',)),
}
_CHAR = r"(?P<char>'(?:\\.[^']{0,8}|[^'\\\n])')"


@cache
def _pattern(language: str) -> re.Pattern:
    lines, blocks, quotes = STYLES[language]
    parts = [f"(?P<b{k}>{re.escape(a)}(?:(?!{re.escape(b)})[\\s\\S])*(?:{re.escape(b)})?)" for k, (a, b) in enumerate(blocks)]
    for k, a in enumerate(lines):
        guard = r"(?!\[)" if a == "#" and language == "php" else ""
        parts.append(f"(?P<l{k}>{re.escape(a)}{guard}[^\n]*)")
    for k, q in enumerate(quotes):
        if len(q) == 3 or q == "`":
            parts.append(f"(?P<s{k}>{q}(?:\\\\[\\s\\S]|(?!{q})[^\\\\])*(?:{q})?)")
        else:
            parts.append(f"(?P<s{k}>{q}(?:\\\\[\\s\\S]|[^{q}\\\\\n])*{q}?)")
    if "'" not in quotes and language not in ("elisp", "commonlisp", "scheme"):
        parts.append(_CHAR)
    return re.compile("|".join(parts))


def mask(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and the insides of strings as spaces (line feeds and outer quotes stay), and the comments' spans."""
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        s = m[0]
        if m.lastgroup[0] in "bl":
            comments.append(m.span())
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + (s[-1] if len(s) > 1 else "")

    return _pattern(language).sub(blank, text), comments


def comment_before(text: str, comments: list[tuple[int, int]], at: int) -> str | None:
    """Comments that end right above an offset, without their marks."""
    found: list[str] = []
    for start, end in reversed(comments):
        if end > at:
            continue
        if text[end:at].strip() or text[end:at].count("\n") > 1:
            break
        found.append(text[start:end])
        at = start
    cleaned = [re.sub(r"^[\s/*#;!]+|[\s*/]+$", "", line) for block in reversed(found) for line in block.split("\n")]
    return "\n".join(x for x in cleaned if x) or None


def pairs(code: str, opens: str = "{", closes: str = "}") -> tuple[dict[int, int], int, int]:
    """Where each opening brace of masked code closes; and how many closings had no opening, and openings no closing."""
    stack, found, extra = [], {}, 0
    for m in re.finditer(f"[{re.escape(opens + closes)}]", code):
        if m[0] in opens:
            stack.append(m.start())
        elif stack:
            found[stack.pop()] = m.start()
        else:
            extra += 1
    return found, extra, len(stack)
