"""Rows that an extractor makes, and the scopes they are made in."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field

#: Kinds of nodes and edges of the graph, some of which only other tools emit.
NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component".split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
CALLABLE = ("function", "method")
TYPES = ("class", "struct", "interface", "trait", "enum", "protocol", "namespace")


def short_id(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def node_id(path: str, qualified: str) -> str:
    return short_id(f"{path}::{qualified}")


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    body: tuple[int, int] = (0, 0)
    signature: str | None = None
    docstring: str | None = None
    visibility: str | None = None
    exported: bool = False
    is_async: bool = False
    is_static: bool = False
    is_abstract: bool = False
    qualified: str = ""
    parent: Symbol | None = None
    name_at: int = -1


@dataclass
class Extraction:
    """Nodes, containment edges and references of one file, as plain tuples ready for Arrow."""

    path: str
    language: str
    text: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    parse_errors: int = 0
    parse_missing: int = 0

    def __post_init__(self):
        self._lines = [0] + [k + 1 for k, c in enumerate(self.text) if c == "\n"]
        self.file_id = node_id(self.path, self.path)
        self._node(self.file_id, "file", self.path.rsplit("/", 1)[-1], self.path, 1, max(1, self.text.count("\n") + (not self.text.endswith("\n"))), None, None, None, False, False, False, False)

    def line(self, offset: int) -> int:
        return bisect_right(self._lines, offset)

    def _node(self, id_, kind, name, qualified, start, end, signature, docstring, visibility, exported, is_async, is_static, is_abstract):
        self.nodes.append(dict(id=id_, kind=kind, name=name, qualified_name=qualified, file_path=self.path, language=self.language, start_line=start, end_line=end, signature=signature, docstring=docstring, visibility=visibility, is_exported=exported, is_async=is_async, is_static=is_static, is_abstract=is_abstract))

    def id_of(self, symbol: Symbol | None) -> str:
        return node_id(self.path, symbol.qualified) if symbol else self.file_id

    def add(self, s: Symbol) -> str:
        s.qualified = f"{s.parent.qualified if s.parent else self.path}::{s.name}"
        id_ = self.id_of(s)
        self._node(id_, s.kind, s.name, s.qualified, self.line(s.start), self.line(max(s.start, s.end - 1)), s.signature, s.docstring, s.visibility, s.exported, s.is_async, s.is_static, s.is_abstract)
        self.edges.append(dict(source=self.id_of(s.parent), target=id_, kind="contains", confidence=1.0))
        return id_

    def refer(self, source: Symbol | None, target: str, kind: str, hint: str | None = None) -> None:
        if target:
            self.refs.append(dict(source_node_id=self.id_of(source), target_name=target, kind=kind, file_path=self.path, receiver_hint=hint))
