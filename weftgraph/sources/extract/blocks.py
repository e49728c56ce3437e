"""Extractor for languages whose scopes are braces."""

from __future__ import annotations

import re

from .grammar import GRAMMARS, KEYWORDS, Grammar
from .masking import comment_before, mask, pairs
from .model import CALLABLE, TYPES, Extraction, Symbol

_CALL = re.compile(r"(?P<before>\bnew[ \t]+)?(?P<chain>(?:[\w$\\]+(?:\([^()]*\))?(?:<[\w:, ]*>)?(?:::|\?\.|!!\.|\.|->))*)(?P<name>[A-Za-z_$][\w$]*)(?P<bang>!?)(?:::<[^()]*?>|<[\w:, .\[\]]*>)?[ \t]*\(")
_CONTROL = frozenset("if for while switch catch return else do new".split())
_LINK = re.compile(r"::|\?\.|!!\.|->|\.")
_TYPED = (
    re.compile(r"\b(?:let|var|val|const)[ \t]+(?:mut[ \t]+)?(?P<v>\w+)[ \t]*(?::[^=;\n]+)?=[ \t]*(?:new[ \t]+)?(?P<t>[A-Z]\w+)(?=[ \t]*(?:\(|\{|::|<))"),
    re.compile(r"\b(?P<v>[a-z_]\w*)[ \t]*:[ \t]*(?:&|mut\b|dyn\b|'\w+|[ \t])*(?P<t>[A-Z]\w+)"),
    re.compile(r"\b(?P<t>[A-Z]\w+)(?:<[\w, ]*>)?[ \t]+\*?(?P<v>[a-z_]\w*)[ \t]*(?==|;|,|\))"),
    re.compile(r"\$(?P<v>\w+)[ \t]*=[ \t]*new[ \t]+(?P<t>[A-Z]\w+)"),
)


def clean_type(spelled: str) -> str:
    """The short name of a type: no borrow marks, lifetimes, generics or path."""
    s = re.sub(r"<.*", "", re.sub(r"&|\bmut\b|\bdyn\b|\bimpl\b|'\w+", " ", spelled)).strip().rstrip("?[]")
    return re.split(r"::|\.|\\", s)[-1].strip()


def names_of(spelled: str | None) -> list[str]:
    return [n for part in re.split(r"[,+]", re.sub(r"<[^<>]*>", "", spelled or "")) if (n := clean_type(re.sub(r"\b(?:public|private|protected|virtual)\b|\(.*", "", part)))]


def qualifier_hint(last: str, grammar: Grammar, types: dict[str, str]) -> str | None:
    """What a call's receiver says of its type: its own (Self), a named one (!T, authoritative), or one inferred (T)."""
    if last in grammar.self_words:
        return "Self"
    if len(last) > 1 and last[0].isupper():
        return "!" + last
    return types.get(last.lstrip("$"))


def extract(path: str, language: str, text: str) -> Extraction:
    grammar, out = GRAMMARS[language], Extraction(path, language, text)
    code, comments = mask(text, language)
    braces, out.parse_errors, out.parse_missing = pairs(code)
    symbols = _symbols(grammar, code, text, comments, braces, path)
    stack: list[Symbol] = []
    for s in symbols:
        while stack and not (stack[-1].body[0] <= s.start < stack[-1].body[1]):
            stack.pop()
        s.parent = stack[-1] if stack else None
        if s.kind == "function" and s.parent and s.parent.kind in TYPES and not (s.parent.kind == "namespace" and language in ("cpp", "csharp", "php", "javascript", "typescript")):
            s.kind = "method"
        if s.kind == "method" and not s.parent and language in ("javascript", "typescript"):
            continue
        if s.kind in ("variable",) and s.parent and s.parent.kind in CALLABLE:
            continue
        if s.body[1] > s.body[0]:
            stack.append(s)
        s.qualified = "kept"
    kept = [s for s in symbols if s.qualified]
    for s in kept:
        out.add(s)
    for s in kept:
        for name in names_of(getattr(s, "base", None)):
            out.refer(s, name, "extends")
        for name in names_of(getattr(s, "impl", None)):
            out.refer(s, name, "implements")
    _members(out, kept, code, language)
    _imports(out, grammar, code, text)
    _calls(out, grammar, kept, code, language)
    return out


def _symbols(grammar: Grammar, code: str, text: str, comments, braces: dict[int, int], path: str) -> list[Symbol]:
    found: dict[int, Symbol] = {}
    for kind, pattern in grammar.rules:
        for m in pattern.finditer(code):
            at = m.start("name")
            if at in found or m["name"] in _CONTROL:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            s = Symbol(kind, re.sub(r"\s+", " ", m["name"]).strip(), start, m.end(), name_at=at)
            groups = m.groupdict()
            mods = (groups.get("mods") or "") + " " + code[max(0, code.rfind("\n", 0, start) + 1) : at]
            s.base, s.impl, s.recv = groups.get("base"), groups.get("impl"), (groups.get("recv") or "").rstrip(":")
            _body(s, m.end(), code, braces)
            s.signature = re.sub(r"\s+", " ", text[start : s.body[0] - 1 if s.body[1] else s.end]).strip()
            s.docstring = comment_before(text, comments, code.rfind("\n", 0, start) + 1 if not code[code.rfind("\n", 0, start) + 1 : start].strip() else start)
            words = set(re.findall(r"\w+", mods))
            s.visibility = next((v for v in ("public", "private", "protected", "internal", "fileprivate") if v in words), "public" if "pub" in words else None)
            s.is_async, s.is_static, s.is_abstract = bool(words & {"async", "suspend"}), "static" in words, "abstract" in words
            s.exported = {"pub": "pub" in words, "capital": m["name"][:1].isupper(), "public": "public" in words, "export": "export" in words, "not_private": not words & {"private", "fileprivate"}, "underscore": not m["name"].startswith("_")}.get(grammar.exported, True)
            if grammar.exported == "pub" and kind == "namespace":
                s.exported = False
            if s.recv and kind == "function":
                s.kind = "method"
            found[at] = s
    return sorted(found.values(), key=lambda s: (s.start, s.name_at))


def _body(s: Symbol, at: int, code: str, braces: dict[int, int]) -> None:
    """Where a declaration's body is: its braces, or the expression up to the end of its line or statement."""
    depth = 0
    for k in range(at, len(code)):
        c = code[k]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c == "{":
            end = braces.get(k, len(code) - 1)
            s.body, s.end = (k + 1, end), end + 1
            return
        elif depth <= 0 and (c == ";" or c == "}" or (c == "=" and code[k + 1 : k + 2] != ">" and s.kind in CALLABLE)):
            if c == "=":
                stop = min((x for x in (code.find("\n", k), code.find(";", k)) if x >= 0), default=len(code))
                if "{" in code[k:stop]:
                    brace = code.index("{", k)
                    stop = braces.get(brace, stop) + 1
                s.body, s.end = (k + 1, stop), stop
            else:
                s.end = k
            return
        elif depth <= 0 and c == "=" and code[k + 1 : k + 2] == ">":
            rest = code[k + 2 :].lstrip()
            if not rest.startswith("{"):
                stop = min((x for x in (code.find("\n", k), code.find(";", k)) if x >= 0), default=len(code))
                s.body, s.end = (k + 2, stop), stop
                return
    s.end = max(s.end, at)


def _members(out: Extraction, symbols: list[Symbol], code: str, language: str) -> None:
    """Fields of structs and variants of enums, one level deep."""
    for s in symbols:
        if not s.body[1] or s.kind not in ("struct", "enum") or language not in ("rust", "typescript", "javascript", "java", "csharp", "kotlin", "swift", "go"):
            continue
        inner = re.sub(r"\{[^{}]*\}|\([^()]*\)", lambda m: " " * len(m[0]), code[s.body[0] : s.body[1]])
        if s.kind == "enum":
            pattern = r"\bcase[ \t]+(\w+)" if language == "swift" else r"(?:^|,)\s*(?:#\[[^\]]*\]\s*)*([A-Za-z_]\w*)(?=\s*(?:,|=|\(|\{|$|\n))"
            kind = "enum_member"
        elif language == "rust":
            pattern, kind = r"(?:^|[,\n])\s*(?:pub(?:\([^)]*\))?\s+)?([a-z_]\w*)\s*:(?!:)", "field"
        elif language == "go":
            pattern, kind = r"^[ \t]*([A-Za-z_]\w*)[ \t]+[\w*\[\].]+", "field"
        else:
            continue
        for m in re.finditer(pattern, inner, re.MULTILINE):
            at = s.body[0] + m.start(1)
            out.add(Symbol(kind, m[1], at, at + len(m[1]), parent=s, exported=s.exported))


def _imports(out: Extraction, grammar: Grammar, code: str, text: str) -> None:
    seen = set()
    for pattern in grammar.imports:
        for m in pattern.finditer(text):
            if m.start(1) in seen or code[m.start() : m.start(1)].strip() != text[m.start() : m.start(1)].strip():
                continue
            seen.add(m.start(1))
            target = re.sub(r"\s+", " ", m[1]).strip("\"'<> ")
            out.add(Symbol("import", target, m.start(1), m.end(1)))
            out.refer(None, target, "imports")


def _calls(out: Extraction, grammar: Grammar, symbols: list[Symbol], code: str, language: str) -> None:
    declared = {s.name_at for s in symbols}
    signatures = [s.body for s in symbols if s.kind == "interface" and language in ("javascript", "typescript")]  # members, no calls
    scopes = sorted((s for s in symbols if s.kind in CALLABLE and s.body[1]), key=lambda s: s.body[0])
    types: dict[int, dict[str, str]] = {}

    def types_in(scope: Symbol | None) -> dict[str, str]:
        key = id(scope)
        if key not in types:
            part = code[scope.start : scope.body[1]] if scope else code
            types[key] = {m["v"]: m["t"] for p in _TYPED for m in p.finditer(part)}
        return types[key]

    for m in _CALL.finditer(code):
        at, name = m.start("name"), m["name"]
        if at in declared or name in KEYWORDS and not m["chain"] or name in grammar.self_words:
            continue
        if any(a <= at < b for a, b in signatures):
            continue
        scope = None
        for s in scopes:
            if s.body[0] > at:
                break
            if at < s.body[1]:
                scope = s
        if m["before"] and grammar.new:
            out.refer(scope, clean_type(m["chain"] + name), "instantiates")
            continue
        if m["bang"] and language == "rust":
            continue
        if scope is None and language in ("rust", "c", "cpp", "java", "csharp", "go") and not m["chain"]:
            continue
        links = [x for x in _LINK.split(re.sub(r"\([^()]*\)|<[^<>]*>", "", m["chain"])) if x]
        hint = qualifier_hint(links[-1], grammar, types_in(scope)) if links else None
        out.refer(scope, name, "calls", hint)
