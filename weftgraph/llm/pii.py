"""Personal data: base patterns, and a skip-chain conditional random field that adds spans."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, only, slices

KINDS = ("email", "ip", "card", "phone")
#: Least marginal probability of a token's label for a span that the base patterns do not have.
LEAST = 0.8
#: Change of a message (in log-potential) below which a text's messages count as settled.
SETTLED = 1e-4
#: Undamped sweeps; messages that still swing after them are damped more with each further sweep.
FREE_SWEEPS = 20
#: Log-potential of the label that a base span gives its tokens.
GIVEN = 30.0

# The base patterns. Digits are matched from the start of their run, which finds the
# same leftmost matches without trying each digit of a long run.
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_BEARS = re.compile(r"[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and kind; leftmost and non-overlapping within a kind."""
    found: list[tuple[int, int, int]] = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if m:
            found.append((start, 0, m.end()))
            low = m.end()
        at = text.find("@", low)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of non-space characters that hold a digit or an @, without punctuation around them.

    Every other token is taken as labelled nothing beforehand and has no place in the graph,
    so chains end there.
    """
    out, low = [], 0
    for m in _BEARS.finditer(text):
        start, end = m.start(), m.end()
        while start > low and not text[start - 1].isspace():
            start -= 1
        low = end
        while end > start and text[end - 1] in ".,;:!?\"'<>[]{}":
            end -= 1
        while start < end and text[start] in ".,;:!?\"'<>[]{}":
            start += 1
        if start < end:
            out.append((start, end))
    return out


# Words just before a token that speak for a kind.
_CUES = {"mail": 0, "email": 0, "e-mail": 0, "ip": 1, "host": 1, "address": 1, "card": 2, "visa": 2, "mastercard": 2, "phone": 3, "tel": 3, "call": 3, "fax": 3, "mobile": 3}
_SHAPES = [
    re.compile(p)
    for p in (
        r"[^@]+@[^@]+\.[^@]+\Z",
        r"[^@]*@",
        r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z",
        r"\+[0-9]+\Z",
        r"\+[0-9(][0-9().-]*\Z",
        r"\([0-9]{2,4}\)\Z",
        r"[0-9]{3}-[0-9]{4}\Z",
        r"[0-9]{3}-[0-9]{3}-[0-9]{4}\Z",
        r"[0-9]{1,4}\Z",
        r"[0-9]{5,13}\Z",
        r"[0-9]{14,19}\Z",
        r"[0-9]{20,}\Z",
        r".*[A-Za-z]",
    )
]
_N_FEATURES = 1 + 4 + len(_SHAPES) + 4 + 2 + 4
_LABELS = 1 + len(KINDS)


def _in_base(features: list[int]) -> bool:
    return any(0 < f < _LABELS for f in features[:2])


class Graph:
    """Tokens of many texts as one graph: chain edges between neighbours, skip edges between repeated or similar ones.

    A token outside base spans is linked to the repeat before it and also to the first repeat
    within a base span, wherever that stands, so that evidence need not pass other repeats.
    Edges go from the earlier token to the later one.
    """

    def __init__(self):
        self.features: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []  # kind 0 chain, 1 equal, 2 similar
        self.at: list[tuple[int, int, int]] = []  # text, start, end

    def add(self, k: int, text: str, base: list[tuple[int, int, int]]) -> None:
        equal: dict[str, int] = {}
        similar: dict[str, int] = {}
        given: tuple[dict[str, int], dict[str, int]] = {}, {}  # first repeat in a base span, by key and by near
        hidden: list[tuple[int, str, str]] = []
        skips: set[tuple[int, int]] = set()
        last_end, b = -1, 0
        open_spans: list[tuple[int, int, int]] = []  # base spans that start before the token's end and end after its start
        for start, end in tokens(text):
            node, core = len(self.at), text[start:end]
            while b < len(base) and base[b][0] < end:
                open_spans.append(base[b])
                b += 1
            open_spans = [x for x in open_spans if x[2] > start]
            on = [0, *(1 + kind for _, kind, _ in open_spans[:1])]
            on += [5 + j for j, shape in enumerate(_SHAPES) if shape.match(core)]
            before = text[max(0, start - 16) : start].lower().split()
            if before and (cue := _CUES.get(before[-1].strip(":.,;()"))) is not None:
                on.append(5 + len(_SHAPES) + cue)
            digits = _NOT_DIGIT.sub("", core)
            if 14 <= len(digits) <= 19:
                on.append(9 + len(_SHAPES) + (not luhn(digits)))
            on.append(11 + len(_SHAPES) + min(3, len(digits) // 4))
            self.features.append(on)
            self.at.append((k, start, end))
            if last_end >= 0 and start - last_end <= 3 and not any(map(str.isalnum, text[last_end:start])):
                self.edges.append((node - 1, node, 0))
            last_end = end
            key = core.lower() if "@" in core else digits if len(digits) >= 6 else ""
            if key:
                equal_before = equal.get(key, -1)
                if equal_before >= 0:
                    self.edges.append((equal_before, node, 1))
                    skips.add((equal_before, node))
                equal[key] = node
                near = key.split("@")[0] if "@" in core else key[-7:]
                if near in similar and similar[near] != equal_before:
                    self.edges.append((similar[near], node, 2))
                    skips.add((similar[near], node))
                similar[near] = node
                if _in_base(on):
                    given[0].setdefault(key, node)
                    given[1].setdefault(near, node)
                else:
                    hidden.append((node, key, near))
        for node, key, near in hidden:
            kind = 1 if key in given[0] else 2
            first = given[0].get(key, given[1].get(near, node))
            if first != node and (edge := (min(first, node), max(first, node))) not in skips:
                self.edges.append((*edge, kind))

    def unary(self, weight: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(self.features)), [len(f) for f in self.features])
        out = np.zeros((len(self.features), _LABELS))
        flat = np.concatenate([np.array(f) for f in self.features])
        np.add.at(out, rows, weight[flat])
        given = (flat > 0) & (flat < _LABELS)
        out[rows[given], flat[given]] += GIVEN
        return out


def marginals(graph: Graph, weight: np.ndarray, pair: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Approximate label marginals by sum-product message passing on the loopy graph, until the messages settle.

    A sweep goes forward and backward over the tokens in their order (those that stand
    equally deep in their texts at once), so it carries evidence through a whole text. A
    text is done when no message of a sweep changes by ``SETTLED``. Tokens of base spans
    are observed, as in training: what they send does not depend on what they are sent.
    ``rounds`` is the most sweeps; None for as many as it takes.
    """
    unary = graph.unary(weight)
    belief = unary.copy()
    if graph.edges:
        e = np.array(graph.edges)
        n = len(e)
        source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        table = np.concatenate([pair[e[:, 2]], pair[e[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(n) + n, np.arange(n)])
        text = np.array([k for k, _, _ in graph.at])[source]
        held = np.array([_in_base(f) for f in graph.features])[source]
        sent = np.zeros((2 * n, _LABELS))
        depth = [0] * len(graph.at)
        for a, b, _ in sorted(graph.edges):
            depth[b] = max(depth[b], depth[a] + 1)
        depth_of = np.array(depth)[source]
        way = np.concatenate([depth_of[:n], 2 * len(depth) - depth_of[n:]])  # forward by depth, then backward
        live, sweep = np.arange(2 * n), 0
        while len(live) and (rounds is None or sweep < rounds):
            step = 1.0 if sweep < FREE_SWEEPS else 0.5 * 0.97 ** (sweep - FREE_SWEEPS)
            change = np.zeros(int(text.max()) + 1)
            live = live[np.argsort(way[live], kind="stable")]
            for own in np.split(live, np.flatnonzero(np.diff(way[live])) + 1):
                out = np.where(held[own, None], unary[source[own]], belief[source[own]] - sent[back[own]])
                x = out[:, :, None] + table[own]
                top = x.max(1, keepdims=True)
                new = np.log(np.exp(x - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                more = step * (new - sent[own])
                sent[own] += more
                np.add.at(belief, target[own], more)
                np.maximum.at(change, text[own], np.abs(more).max(1))
            live, sweep = live[change[text[live]] >= SETTLED], sweep + 1
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def labelled_table() -> list[tuple[str, list[tuple[str, int]]]]:
    """The small labelled table that the field is trained on, made by a rule with a fixed seed.

    Each text comes with the substrings that are personal data and their kinds. It has
    data in the base form, repeats of it in other forms (linked by skip edges), data that
    the base patterns lose because two numbers meet, and numbers that are nothing.
    """
    rng = np.random.default_rng(7)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        head = "4" + digits(14)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    def no_card() -> str:
        c = card()
        return c[:-1] + str((int(c[-1]) + 3) % 10)

    out = []
    for k in range(320):
        area, line = str(rng.integers(200, 999)), f"{rng.integers(200, 999)}-{digits(4)}"
        phone, mail = f"+1 ({area}) {line}", f"user{digits(2)}@mail{digits(1)}.example.com"
        ip, c = ".".join(str(x) for x in rng.integers(1, 255, 4)), card()
        nothing = [digits(4), f"2{digits(3)}-0{rng.integers(1, 9)}-1{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"v{digits(2)}", digits(7), no_card(), f"{digits(2)}:{digits(2)}", f"{digits(3)}-{digits(4)}", digits(10), f"@{'abcdef'[k % 6]}bc", f"({digits(3)})", digits(24), f"300.{digits(2)}.{digits(1)}.999", f"x{digits(1)}@home"]
        some = [nothing[i] for i in rng.integers(0, len(nothing), 4)]
        form = k % 10
        if form == 0:
            text, spans = f"it was {some[0]} and {phone} so {some[1]} again {line} more {some[2]}", [(phone, 4), (line, 4)]
        elif form == 1:
            text, spans = f"the {mail} of {some[0]} then {mail.upper()} or {some[1]}", [(mail, 1), (mail.upper(), 1)]
        elif form == 2:
            text, spans = f"in {some[0]} at {ip} by {some[1]} to {ip} end {some[2]}", [(ip, 2)]
        elif form == 3:
            text, spans = f"some {c} for {some[0]} in {some[1]} and {c} at last", [(c, 3)]
        elif form == 4:
            text, spans = f"so {phone} {c} went {some[0]} and {some[1]} with", [(phone, 4), (c, 3)]
        elif form == 5:
            text, spans = f"an {some[0]} or {some[1]} and {some[2]} with {some[3]} none", []
        elif form == 8:
            text, spans = f"so {phone} is {some[0]} or ({area}) {line} of {some[1]} ({digits(3)}) {some[2]}", [(phone, 4), (f"({area}) {line}", 4)]
        elif form == 9:
            text, spans = f"with {c} {phone} {some[0]} then", [(c, 3), (phone, 4)]
        elif form == 6:
            bare = area + line.replace("-", "")
            text, spans = f"first {phone} then {some[0]} is {bare} near {some[3]}", [(phone, 4), (bare, 4)]
        else:
            text, spans = f"{some[0]} {some[1]} {some[2]} {mail} {some[3]} it", [(mail, 1)]
        out.append((text, spans))
    return out


@functools.cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    """Weights of token features and of label pairs by kind of edge, fitted by regularised pseudo-likelihood."""
    graph, labels = Graph(), []
    for k, (text, spans) in enumerate(labelled_table()):
        first = len(graph.at)
        graph.add(k, text, base_spans(text))
        where = [(m.start(), m.end(), kind) for s, kind in spans for m in re.finditer(re.escape(s), text)]
        for _, start, end in graph.at[first:]:
            labels.append(next((kind for a, b, kind in where if a < end and b > start), 0))
    y, n = np.array(labels), len(labels)
    x = np.zeros((n, _N_FEATURES))
    for i, f in enumerate(graph.features):
        x[i, f] = 1
    near = np.zeros((4, n, _LABELS))  # labels of neighbours: chain before, chain after, equal, similar
    for a, b, kind in graph.edges:
        for u, v, place in ((a, b, 0), (b, a, 1)):
            near[place if kind == 0 else kind + 1, v, y[u]] += 1
    hidden = x[:, 1:_LABELS].sum(1) == 0  # the others' labels are given by the base patterns
    every, goal = np.concatenate([x, *near], axis=1)[hidden], np.eye(_LABELS)[y[hidden]]
    w, m1, m2 = np.zeros((every.shape[1], _LABELS)), 0.0, 0.0
    heed = np.where(goal[:, 0] > 0, 1.0, 4.0)[:, None]  # data are rare, also in the table
    for step in range(1, 3001):  # Adam
        z = every @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = every.T @ (heed * (goal - p)) / len(every) - 1e-5 * w
        chain, other, *skips = (slope[_N_FEATURES + k * _LABELS : _N_FEATURES + (k + 1) * _LABELS] for k in range(4))
        tied = chain + other.T  # a pair has one table, whichever of the two is asked
        slope = np.concatenate([slope[:_N_FEATURES], tied, tied.T, *(x + x.T for x in skips)])
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope**2
        w += 0.03 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    parts = [w[_N_FEATURES + k * _LABELS : _N_FEATURES + (k + 1) * _LABELS] for k in range(4)]
    pair = np.stack([parts[0], parts[2], parts[3]])
    return w[:_N_FEATURES], pair


def find(texts: list[str], least: float = LEAST, field: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans, (start, kind, end), of each text; ``field`` has the weights, by default those of :func:`trained`."""
    base = [base_spans(t) for t in texts]
    graph = Graph()
    for k, text in enumerate(texts):
        graph.add(k, text, base[k])
    spans = [list(b) for b in base]
    if graph.at:
        p = marginals(graph, *(field or trained()))
        label = np.where(p[:, 1:].max(1) >= least, p[:, 1:].argmax(1), -1)
        linked = {(a, b) for a, b, kind in graph.edges if kind == 0}
        free = [s >= 0 and not _in_base(f) for f, s in zip(graph.features, label.tolist())]
        i = 0
        while i < len(graph.at):
            j = i + 1
            if free[i]:
                while j < len(graph.at) and free[j] and label[j] == label[i] and (j - 1, j) in linked:
                    j += 1
                k, start, _ = graph.at[i]
                spans[k].append((start, int(label[i]), graph.at[j - 1][2]))
            i = j
        for s in spans:
            s.sort()
    return list(zip(base, spans))


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
_SLICE = 512


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (counts of base spans), ``base_sha256``
    (of the base spans, spelled kind:start:end) and ``spans`` (all spans, spelled alike).
    Offsets count code points, ends are exclusive.

    Base matches are what the patterns give. Tokens that hold a digit or an @ are the nodes
    of a skip-chain conditional random field: neighbours are chained, and occurrences of an
    equal or similar token anywhere in the document are linked one to the next, and those
    outside base spans also to the first one within (so n repeats have at most 2n links);
    sum-product messages on that graph, passed until they settle, carry a label from where
    it is evident to where it is not. Runs of tokens outside base spans whose marginal
    reaches ``least`` are added. The field is trained on a small table made by a rule.

    One narrow pass; texts of a batch are one disjoint graph. Null text counts as empty:
    no spans; a null id stays null; repeated rows give repeated results; an empty table
    gives none; other columns are ignored.
    """
    field = trained()

    def fold(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found = [x for at in range(0, len(texts), _SLICE) for x in find(texts[at : at + _SLICE], least, field)]
        counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(4)]
        return {
            "doc_id": batch.column(0),
            **{f"n_{kind}": counts[k] for k, kind in enumerate(KINDS)},
            "base_sha256": [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found],
            "spans": [spelled(spans) for _, spans in found],
        }

    return map_rows(only(df, doc_id=id_col, text=text_col), fold, SCHEMA)


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch of spans replaced by its first kind in angle brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``df`` with the spans of :func:`personal_data` masked in its text, and the count of characters in ``chars_col`` renewed.

    All rows and columns stay, whatever their names. Null and empty texts stay as they
    are, as does a null id; repeated rows give repeated results; an empty table gives none.
    One narrow pass.
    """
    field = trained()

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            new: list[str | None] = []
            for at in range(0, len(texts), _SLICE):
                some = texts[at : at + _SLICE]
                new += [t and masked_text(t, spans) for t, (_, spans) in zip(some, find([t or "" for t in some], field=field))]
            columns = list(batch.columns)
            columns[batch.schema.get_field_index(text_col)] = pa.array(new, batch.schema.field(text_col).type)
            if chars_col:
                columns[batch.schema.get_field_index(chars_col)] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(chars_col).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
