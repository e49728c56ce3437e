"""Pre-tokens of the public byte-level and word-end BPE tokenizers, and bounded caches of their pieces.

The fast splitter is used only for texts all of whose characters lie in ranges where the
pattern engine here and the tokenizer library's own agree (see ``SAFE``, which a test
checks code point by code point); any other text is split by the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections import ChainMap

import regex

from .common import worker_state

# The pre-token patterns of the two tokenizer files, and ranges of characters
# that every Unicode version in use classifies alike and whose lower case is among them: all of the
# basic plane but letters that are new there or stand for ones beyond it, and the pictographs.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAFE = "\u0000-\u1c88\u1c8b-\ua7ca\ua7dd-\ud7ff\ue000-\uf9ff\ufb00-\uffff\U0001f300-\U0001faff"

_unsafe = re.compile(f"[^{SAFE}]")

#: Entries in each of the two generations of a worker's cache of pieces; bounds a worker's memory.
CACHE_ENTRIES = 250_000
#: Longest pre-token kept in a cache, in characters.
CACHE_CHARS = 64


def _char_class(member) -> str:
    """The safe characters for which ``member`` holds, as ranges for a character class."""
    ranges: list[list[int]] = []
    for low, high in regex.findall(r"(.)-(.)", SAFE, regex.DOTALL):
        for cp in range(ord(low), ord(high) + 1):
            if member(chr(cp)):
                if ranges and ranges[-1][1] == cp - 1:
                    ranges[-1][1] = cp
                else:
                    ranges.append([cp, cp])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in ranges)


@functools.cache
def _splitter(kind: str) -> re.Pattern:
    """The pre-token pattern spelled out over the safe characters, for the faster standard engine."""
    letter, number = (_char_class(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    space = _char_class(lambda c: regex.match(r"\s", c) is not None)
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    if kind == "word":
        return re.compile(f"{short}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
    return re.compile(f"{short}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


# Normaliser and pre-tokenizer of the two kinds of files that have a fast splitter.
KINDS = {
    json.dumps([None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]): "byte",
    json.dumps(
        [
            {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
            {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_END}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        ]
    ): "word",
}


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level pre-token stands for: printable ones themselves, the others those from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE_OF = _byte_alphabet()


class Pieces:
    """One tokenizer file in one worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {x.content: i for i, x in added.items()}
        self.plain_special = not any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in added.values())
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        told = [part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.kind = KINDS.get(json.dumps(told), "other")
        self.pattern = _splitter(self.kind) if self.kind != "other" else None
        # A pre-token of safe characters has been normalised already, so the model and its byte alphabet do for it.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.found: dict[str, bytes | int] = {}
        self.older: dict[str, bytes | int] = {}

    def segments(self, text: str) -> tuple[list[str], list[str]]:
        """The stretches between special strings, and those strings."""
        if not self.special or not self.split_special.search(text):
            return [text], []
        return self.split_special.split(text), self.split_special.findall(text)

    def fast(self, text: str) -> bool:
        return self.kind != "other" and self.plain_special and not _unsafe.search(text)

    def pretokens(self, segment: str) -> list[str]:
        """Pre-tokens of any stretch without special strings: by the fast splitter, or by the library for characters that it may split otherwise."""
        if self.kind != "other" and not _unsafe.search(segment):
            return self.split(segment)
        if self.tokenizer.normalizer:
            segment = self.tokenizer.normalizer.normalize_str(segment)
        if not self.tokenizer.pre_tokenizer:
            return [segment] if segment else []
        found = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment)]
        return found if self.kind == "other" else [bytes(map(_BYTE_OF.__getitem__, p)).decode() for p in found]

    def numbers(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        if self.kind == "other":
            return [len(self.tokenizer.model.tokenize(p)) for p in pretokens]
        return [len(e) for at in range(0, len(pretokens), 4096) for e in self.bare.encode_batch_fast(pretokens[at : at + 4096], add_special_tokens=False)]

    def split(self, segment: str) -> list[str]:
        """Pre-tokens of a stretch without special strings and of safe characters."""
        if self.kind == "word":
            segment = unicodedata.normalize("NFC", segment).replace("Σ", "σ").lower()
        return self.pattern.findall(segment)

    def whole(self, text: str) -> list[int]:
        """Ids by the library alone."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, pieces: set[str], value) -> dict:
        """A mapping that has ``value(encoding)`` of all ``pieces``, each encoded once unless the cache has it."""
        found, older = self.found, self.older
        if len(found) > CACHE_ENTRIES:
            older, found = found, {}
            self.found, self.older = found, older
        new = []
        for p in pieces:
            if p not in found:
                if p in older:
                    found[p] = older[p]
                else:
                    new.append(p)
        long = {}
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for p, e in zip(some, self.bare.encode_batch_fast(some, add_special_tokens=False)):
                (found if len(p) <= CACHE_CHARS else long)[p] = value(e)
        return ChainMap(long, found) if long else found

    def trim(self) -> None:
        self.found, self.older = {}, {}


def pieces_of(path: str, use: str) -> Pieces:
    """The tokenizer of ``path`` for one ``use`` (what its cache holds), loaded once in a worker process."""
    return worker_state(("pieces", path, use), lambda: Pieces(path))
