"""Extractors for Python (its own parser), Ruby (keyword blocks), the Lisps (lists) and component files."""

from __future__ import annotations

import ast
import re

from . import blocks
from .masking import comment_before, mask
from .model import CALLABLE, Extraction, Symbol


def _spelled(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except Exception:
        return ""


def extract_python(path: str, language: str, text: str) -> Extraction:
    out = Extraction(path, language, text)
    tree = _parsed(text)
    if tree is None:
        tree = _longest_parse(text)
        out.parse_errors = 1
    lines = out._lines
    at = lambda n: lines[min(n.lineno, len(lines)) - 1]
    until = lambda n: (lines[n.end_lineno] if n.end_lineno < len(lines) else len(text)) - 0

    def hint(value: ast.AST, types: dict[str, str]) -> str | None:
        last = value.attr if isinstance(value, ast.Attribute) else value.id if isinstance(value, ast.Name) else value.func.id if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) else None
        if last in ("self", "cls") or isinstance(value, ast.Call) and last == "super":
            return "Self"
        if last and len(last) > 1 and last[0].isupper():
            return "!" + last
        return types.get(last) if last else None

    # A stack of (node, its container, its callable, known types of names) instead of recursion, so that no nesting is too deep.
    stack: list[tuple[ast.AST, Symbol | None, Symbol | None, dict[str, str]]] = []

    def later(nodes, parent: Symbol | None, scope: Symbol | None, types: dict[str, str]) -> list:
        return [(n, parent, scope, types) for n in nodes]

    stack += reversed(later(tree.body, None, None, {}))
    while stack:
        n, parent, scope, types = stack.pop()
        then: list = []
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names = {d.id if isinstance(d, ast.Name) else getattr(d, "attr", "") for d in n.decorator_list}
            head = text[at(n) :].split(":\n", 1)[0].split("\n", 1)[0].strip().rstrip(":")
            s = Symbol("method" if parent and parent.kind == "class" else "function", n.name, at(n), until(n), signature=head, docstring=ast.get_docstring(n), visibility="private" if n.name.startswith("_") else "public", exported=not n.name.startswith("_"), is_async=isinstance(n, ast.AsyncFunctionDef), is_static="staticmethod" in names, is_abstract="abstractmethod" in names, parent=parent)
            out.add(s)
            own = dict(types)
            for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
                if isinstance(a.annotation, ast.Name):
                    own[a.arg] = a.annotation.id
            then = later([*n.decorator_list, *n.args.defaults, *(x for x in n.args.kw_defaults if x)], parent, scope, types) + later(n.body, s, s, own)
        elif isinstance(n, ast.ClassDef):
            s = Symbol("class", n.name, at(n), until(n), signature=text[at(n) :].split("\n", 1)[0].strip().rstrip(":"), docstring=ast.get_docstring(n), visibility="private" if n.name.startswith("_") else "public", exported=not n.name.startswith("_"), parent=parent)
            out.add(s)
            for b in n.bases:
                out.refer(s, _spelled(b).split("[")[0].split(".")[-1], "extends")
            then = later(n.decorator_list, parent, scope, types) + later(n.body, s, scope, types)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            module = getattr(n, "module", None) or ""
            for a in n.names:
                target = f"{module}.{a.name}" if module else a.name
                out.add(Symbol("import", target, at(n), until(n)))
                out.refer(None, target, "imports")
        elif isinstance(n, ast.Call):
            f, inner = n.func, []
            if isinstance(f, ast.Attribute):
                out.refer(scope, f.attr, "calls", hint(f.value, types))
                inner = [f.value]
            elif isinstance(f, ast.Name):
                out.refer(scope, f.id, "calls")
            else:
                inner = [f]
            then = later([*inner, *n.args, *(k.value for k in n.keywords)], parent, scope, types)
        else:
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id[:1].isupper():
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        types[t.id] = n.value.func.id
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and isinstance(n.annotation, ast.Name):
                types[n.target.id] = n.annotation.id
            then = later(ast.iter_child_nodes(n), parent, scope, types)
        stack += reversed(then)
    return out


def _parsed(text: str) -> ast.Module | None:
    """The syntax tree, or None where Python's parser gives up (also for nesting beyond what it can hold)."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _longest_parse(text: str) -> ast.Module:
    """What parses of a broken file: its top-level chunks one by one, at their own lines."""
    tree = ast.Module(body=[], type_ignores=[])
    rows = text.split("\n")
    starts = [k for k, row in enumerate(rows) if row and not row[0].isspace() and not row.startswith(("#", ")", "]", "}"))] + [len(rows)]
    for a, b in zip(starts, starts[1:]):
        part = _parsed("\n" * a + "\n".join(rows[a:b]))
        tree.body += part.body if part else []
    return tree


_RUBY = re.compile(r"(?m)^[ \t]*(?P<word>module|class|def|if|unless|while|until|case|begin|for)\b(?P<rest>[^\n;]*)|(?P<do>\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?:\n|$)))|(?P<assign>=[ \t]*(?:if|case|begin|unless)\b)|(?<![.\w])(?P<end>end)\b(?![?!:])")
_RUBY_CALL = re.compile(r"(?:(?P<recv>[\w@]+)(?:\.|::|&\.))?(?P<name>[a-z_]\w*[?!]?)\(|(?:(?P<recv2>[A-Z]\w*|self)\.)(?P<name2>[a-z_]\w*[?!]?)")
_RUBY_WORDS = frozenset("if unless while until case def class module end return yield and or not puts require require_relative attr_accessor attr_reader super defined".split())


def extract_ruby(path: str, language: str, text: str) -> Extraction:
    out = Extraction(path, language, text)
    code, comments = mask(text, language)
    stack: list[Symbol | None] = []
    symbols: list[Symbol] = []
    for m in _RUBY.finditer(code):
        if m["end"]:
            if stack:
                s = stack.pop()
                if s:
                    s.end, s.body = m.end(), (s.body[0], m.start())
            else:
                out.parse_errors += 1
            continue
        word, parent = m["word"], next((s for s in reversed(stack) if s), None)
        if word in ("module", "class", "def"):
            rest = m["rest"].strip()
            if word == "class" and rest.startswith("<<"):
                stack.append(None)
                continue
            base = re.search(r"<\s*([\w:]+)", rest) if word == "class" else None
            name = re.match(r"(?:self\.)?([\w:]+[?!=]?)", rest)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            s = Symbol({"module": "module", "class": "class"}.get(word, "method" if parent else "function"), name[1] if name else "?", start, m.end(), (m.end(), len(code)), re.sub(r"\s+", " ", m[0]).strip(), comment_before(text, comments, start - (start - code.rfind("\n", 0, start) - 1)), exported=not (name and name[1].startswith("_")), is_static=rest.startswith("self."), parent=parent)
            out_of_line = word == "def" and re.match(r"[^=\n]*\)?\s=\s", rest)
            symbols.append(s)
            if base:
                s.base = base[1]
            if not out_of_line:
                stack.append(s)
        else:
            stack.append(None)
    out.parse_missing = len([s for s in stack if s])
    for s in symbols:
        out.add(s)
        if getattr(s, "base", None):
            out.refer(s, s.base.split("::")[-1], "extends")
    for m in _RUBY_CALL.finditer(code):
        name, recv = m["name"] or m["name2"], m["recv"] or m["recv2"]
        at = m.start("name") if m["name"] else m.start("name2")
        if name in _RUBY_WORDS or re.search(r"\bdef\s+(?:self\.)?$", code[max(0, at - 12) : at]):
            continue
        scope = next((s for s in reversed(symbols) if s.kind in CALLABLE and s.body[0] <= at < s.body[1]), None)
        out.refer(scope, name, "calls", blocks.qualifier_hint(recv, blocks.Grammar((), self_words=("self",)), {}) if recv else None)
    for m in re.finditer(r"(?m)^[ \t]*require(?:_relative)?[ \t(]+[\"']([^\"'\n]+)", text):
        out.add(Symbol("import", m[1], m.start(1), m.end(1)))
        out.refer(None, m[1], "imports")
    return out


# Words that define something in the Lisps, and what they define.
_DEFINERS = {
    "function": "defun defmacro defsubst defalias cl-defun cl-defmethod cl-defgeneric defmethod defgeneric define-minor-mode define-derived-mode define-syntax define-syntax-rule defsetf".split(),
    "variable": "defvar defcustom defvar-local defparameter defface defgroup".split(),
    "constant": "defconst defconstant".split(),
    "struct": "defstruct cl-defstruct defclass define-condition deftype define-record-type".split(),
    "module": "defpackage define-library module provide".split(),
}
_KIND = {word: kind for kind, every in _DEFINERS.items() for word in every}


def _lists(code: str):
    """Nested lists of masked Lisp code as (start, items, end), items being lists or (offset, atom)."""
    stack: list[tuple[int, list]] = [(0, [])]
    for m in re.finditer(r"[()\[\]]|[^\s()\[\]'`,]+", code):
        if m[0] in "([":
            stack.append((m.start(), []))
        elif m[0] in ")]":
            if len(stack) > 1:
                start, items = stack.pop()
                stack[-1][1].append((start, items, m.end()))
        else:
            stack[-1][1].append((m.start(), m[0]))
    while len(stack) > 1:
        start, items = stack.pop()
        stack[-1][1].append((start, items, len(code)))
    return stack[0][1]


def extract_lisp(path: str, language: str, text: str) -> Extraction:
    out = Extraction(path, language, text)
    code, comments = mask(text, language)
    out.parse_errors, out.parse_missing = max(0, code.count(")") - code.count("(")), max(0, code.count("(") - code.count(")"))

    def atom(x) -> str | None:
        return x[1] if len(x) == 2 else None

    def calls(item, scope: Symbol | None) -> None:
        stack = [item]
        while stack:
            item = stack.pop()
            if len(item) == 2:
                continue
            head = item[1][0] if item[1] else None
            if head is not None and (name := atom(head)) and not name[0].isdigit() and name[0] not in "\"#:?\\":
                out.refer(scope, name, "calls")
            stack += reversed(item[1])

    for form in _lists(code):
        if len(form) == 2 or not form[1]:
            continue
        start, items, end = form
        word = atom(items[0]) or ""
        kind, name = _KIND.get(word.lower()), None
        if len(items) > 1:
            name = atom(items[1]) if len(items[1]) == 2 else next((atom(x) for x in items[1][1] if atom(x)), None)
            if word == "define":
                kind = "variable" if len(items[1]) == 2 and not (len(items) > 2 and len(items[2]) == 3 and items[2][1] and atom(items[2][1][0]) == "lambda") else "function"
        if kind and name:
            s = Symbol(kind, name.lstrip(":#'").strip('"'), start, end, signature=text[start:end].split("\n", 1)[0], docstring=comment_before(text, comments, start), exported=True)
            out.add(s)
            for x in items[2:]:
                calls(x, s if kind == "function" else None)
        else:
            calls(form, None)
        if word in ("require", "import", "use-package", "load") and len(items) > 1:
            target = atom(items[1]) or " ".join(a for x in items[1][1] if (a := atom(x)))
            out.refer(None, target.strip("'\":"), "imports")
    return out


_SCRIPT = re.compile(r"(?is)<script\b([^>]*)>(.*?)</script\s*>")


def extract_component(path: str, language: str, text: str) -> Extraction:
    """Each script element by the JavaScript extractor, at its own lines; the file node is the component's."""
    out = Extraction(path, language, text)
    for m in _SCRIPT.finditer(text):
        before = re.sub(r"[^\n]", " ", text[: m.start(2)])
        inner = blocks.extract(path, "typescript" if re.search(r"lang=[\"']?ts", m[1]) else "javascript", before + m[2])
        out.nodes += [n | {"language": language} for n in inner.nodes if n["kind"] != "file"]
        out.edges += inner.edges
        out.refs += inner.refs
        out.parse_errors += inner.parse_errors
        out.parse_missing += inner.parse_missing
    return out
