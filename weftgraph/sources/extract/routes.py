"""Routes of web frameworks: what is registered by a call, a decorator, an annotation or a file's place."""

from __future__ import annotations

import re
from functools import cache

from .masking import STYLES, mask, pairs
from .model import Extraction, Symbol

# How frameworks spell a route before its path.
VERBS = "get post put delete patch options head all".split()
_JS_RECEIVERS = "app router route server api fastify r".split()
_JS_DECORATORS = "Get Post Put Delete Patch Options Head All".split()
_PY_RECEIVERS = "app router api blueprint bp".split()
_GO_RECEIVERS = "r router e g group mux api v1 rg".split()
_SPRING = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH", "Request": "ANY"}
_ASPNET = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "Route": "ANY"}
_OPTIONS = "methods name to as".split()

_QUOTE = re.compile(r"[\"'`]")
_STRING = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?", re.DOTALL)


@cache
def _pattern(language: str, stem: str) -> re.Pattern | None:
    """One pattern of all spellings of a language; its groups name the verb."""
    verbs, any_of = "|".join(VERBS), "|".join
    if language in ("javascript", "typescript", "svelte", "vue"):
        return re.compile(rf"(?<!\w)(?:{any_of(_JS_RECEIVERS)})\.(?P<v1>{verbs})\(|@(?P<v2>{any_of(_JS_DECORATORS)})\(")
    if language == "python":
        django = r"|(?<!\w)(?:re_)?path\(" if stem == "urls" else ""
        return re.compile(rf"@(?:{any_of(_PY_RECEIVERS)})\.(?:route|(?P<v1>{verbs}))\({django}")
    if language == "ruby":
        return re.compile(rf"(?m)^[ \t]*(?P<v1>{verbs})[ ]") if stem == "routes" else None
    if language == "php":
        return re.compile(rf"Route::(?P<v1>{verbs})\(|#\[Route\(")
    if language == "go":
        return re.compile(rf"(?<!\w)(?:{any_of(_GO_RECEIVERS)})\.(?P<v1>{verbs.upper()})\(")
    if language in ("java", "kotlin"):
        return re.compile(rf"@(?P<spring>{any_of(_SPRING)})Mapping\(")
    if language == "csharp":
        return re.compile(rf"\[(?P<net>{any_of(_ASPNET)})\(")
    return None


def arguments(text: str, at: int, closes: dict[int, int] | None) -> str | None:
    """What stands between the opening bracket before ``at`` and its close (None if it has none); without brackets, up to the end of the line."""
    if closes is None:
        end = text.find("\n", at)
        return text[at : end if end >= 0 else len(text)]
    return text[at : closes[at - 1]] if at - 1 in closes else None


def path_and_handler(inner: str) -> tuple[str, str | None] | None:
    """The first string among a route's arguments, and the last word outside strings unless it names an option."""
    quote = _QUOTE.search(inner)
    end = inner.find(quote[0], quote.end()) if quote else -1
    if end < 0:
        return None
    path = inner[quote.end() : end]
    words = re.findall(r"\w+", _STRING.sub(" ", inner))
    return path, words[-1] if words and words[-1] not in (path, *_OPTIONS) else None


def file_route(path: str, language: str) -> tuple[str, str] | None:
    """Routes by place: ``pages/api/**`` and ``app/**/route`` files."""
    if language not in ("javascript", "typescript"):
        return None
    p = re.sub(r"\.[^./]+$", "", "/" + path.replace("\\", "/").lstrip("/"))
    if m := re.search(r"/pages/api(/.*)$", p):
        return "ANY", re.sub(r"/index$", "", m[1]) or "/"
    if m := re.search(r"/app(/.*)?/route$", p):
        return "ANY", m[1] or "/"
    return None


def append(out: Extraction) -> Extraction:
    """Adds route nodes and references to their handlers to a file's extraction. Routes in comments are none."""
    stem = re.sub(r"\.[^.]*$", "", out.path.rsplit("/", 1)[-1])
    if placed := file_route(out.path, out.language):
        _route(out, 0, *placed, None)
    pattern, closes = _pattern(out.language, stem), None
    for m in pattern.finditer(out.text) if pattern else ():
        groups = m.groupdict()
        verb = groups.get("v1") or groups.get("v2")
        verb = verb.upper() if verb else _SPRING.get(groups.get("spring"), _ASPNET.get(groups.get("net"), "ANY"))
        if closes is None:
            closes = pairs(mask(out.text, out.language if out.language in STYLES else "typescript")[0], "(", ")")[0]
        inner = arguments(out.text, m.end(), closes if m[0].endswith("(") else None)
        if inner is not None and (told := path_and_handler(inner)):
            _route(out, m.start(), verb, *told)
    return out


def _route(out: Extraction, at: int, verb: str, path: str, handler: str | None) -> None:
    s = Symbol("route", f"{verb} {path}", at, at + 1, signature=f"{verb} {path}", exported=True)
    out.add(s)
    if handler:
        out.refer(s, handler, "references")
