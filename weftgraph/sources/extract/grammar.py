"""Declarations of the brace languages, as patterns over masked code.

A rule is (kind, pattern); the pattern names its symbol ``name`` and may name ``base``
(what it extends), ``impl`` (what it implements) and ``mods`` (words before it).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_N = r"(?P<name>[A-Za-z_$][\w$]*)"
_MODS = r"(?P<mods>(?:\b(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|open|partial|readonly|export|default|declare|suspend|inline|extern|unsafe|const|data|mutating|fileprivate|native|synchronized|external|factory|late|required|inner|operator|infix|tailrec|enum|annotation|new)\b[ \t\r\n]+)*)"


@dataclass(frozen=True)
class Grammar:
    rules: tuple[tuple[str, re.Pattern], ...]
    imports: tuple[re.Pattern, ...] = ()
    exported: str = "all"  # pub, capital, public, export, not_private, underscore, all
    self_words: tuple[str, ...] = ("this",)
    new: bool = False
    keywords: frozenset[str] = frozenset()


def _rules(*rules: tuple[str, str]) -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((kind, re.compile(pattern, re.MULTILINE)) for kind, pattern in rules)


_KEYWORDS = frozenset("if for while switch catch return match loop else do try function fn func fun def class new sizeof typeof defer go select when using lock foreach elseif isset empty unset array list require include print echo assert yield await throw in is as where super".split())
_PUB = r"(?P<mods>(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*)"
_HERITAGE_TS = r"(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w.$]+)(?:<[^{]*?>)?)?(?:\s+implements\s+(?P<impl>[\w.,$ \t<>]+?))?"
_HERITAGE_JAVA = r"(?:<[^{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<base>[\w.,<> \t]+?))?(?:\s+implements\s+(?P<impl>[\w.,<>\s]+?))?"
_COLON = r"(?:<[^{]*?>)?(?:\s*\([^{]*?\))?(?:\s*:\s*(?P<impl>[\w.,<>()\s]+?))?"
_RETURN = r"[A-Za-z_][\w<>\[\],.?:*& \t]*?[ \t*&\]>]"

GRAMMARS = {
    "rust": Grammar(
        _rules(
            ("namespace", r"^[ \t]*(?:unsafe[ \t]+)?(?P<name>impl\b(?:[ \t]*<[^{;]*?>)?[ \t]+(?:(?P<impl>[\w:]+)(?:<[^{;]*?>)?[ \t]+for[ \t]+)?(?P<self>[\w:&]+)[^{;]*?)(?=\{|\bwhere\b)"),
            ("function", rf"{_PUB}\bfn[ \t]+{_N}"),
            ("struct", rf"{_PUB}\bstruct[ \t]+{_N}"),
            ("enum", rf"{_PUB}\benum[ \t]+{_N}"),
            ("trait", rf"{_PUB}\btrait[ \t]+{_N}(?:<[^{{]*?>)?(?:[ \t]*:[ \t]*(?P<impl>[\w:+ \t]+?))?(?=[ \t\n]*(?:\{{|where))"),
            ("module", rf"{_PUB}\bmod[ \t]+{_N}"),
            ("type_alias", rf"{_PUB}\btype[ \t]+{_N}"),
            ("constant", rf"{_PUB}\b(?:const|static)[ \t]+(?:mut[ \t]+)?(?P<name>[A-Z_][A-Z0-9_]*)[ \t]*:"),
        ),
        (re.compile(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;]+);", re.MULTILINE),),
        "pub",
        ("self", "Self"),
    ),
    "javascript": Grammar(
        _rules(
            ("class", rf"{_MODS}\bclass[ \t]+{_N}{_HERITAGE_TS}(?=\s*\{{)"),
            ("interface", rf"{_MODS}\binterface[ \t]+{_N}(?:<[^{{]*?>)?(?:\s+extends\s+(?P<base>[\w.$,<> \t]+?))?(?=\s*\{{)"),
            ("enum", rf"{_MODS}\benum[ \t]+{_N}(?=\s*\{{)"),
            ("type_alias", rf"{_MODS}\btype[ \t]+{_N}(?:<[^=]*>)?[ \t]*="),
            ("namespace", rf"{_MODS}\b(?:namespace|module)[ \t]+{_N}(?=\s*\{{)"),
            ("function", rf"{_MODS}\bfunction[ \t]*\*?[ \t]*{_N}[ \t]*(?=[(<])"),
            ("function", rf"{_MODS}\b(?:const|let|var)[ \t]+{_N}(?:[ \t]*:[^=\n]+)?[ \t]*=[ \t]*(?:async[ \t]+)?(?:function\b[^(]*)?(?=\([^()]*(?:\([^()]*\)[^()]*)*\)[^=\n{{]*(?:=>|\{{)|\w+[ \t]*=>)"),
            ("method", rf"^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|abstract|override)[ \t]+)*\*?(?P<name>(?!(?:if|for|while|switch|catch|return|function|new|do|else|await|typeof|with)\b)#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^>(]*>)?\([^;{{}}]*\)[^;{{}}=]*(?=\{{)"),
            ("method", rf"(?<=[{{;}}])[ \t]*(?:(?:static|async|get|set)[ \t]+)*(?P<name>(?!(?:if|for|while|switch|catch|return|function|new|do|else|await|typeof|with)\b)[A-Za-z_$][\w$]*)[ \t]*\([^;{{}}()]*\)[ \t]*(?=\{{)"),
            ("variable", rf"^[ \t]*{_MODS}(?:const|let|var)[ \t]+{_N}(?:[ \t]*:[^=\n]+)?[ \t]*=(?![ \t]*(?:async[ \t]+)?(?:function\b|\([^()]*\)[^=\n]*=>|\w+[ \t]*=>))"),
        ),
        (re.compile(r"^[ \t]*import\b[^;\n]*?(?:from[ \t]*)?(?=[\"'])([\"'][^\"'\n]*[\"'])", re.MULTILINE), re.compile(r"\brequire\(([\"'][^\"'\n]*[\"'])\)")),
        "export",
        ("this", "super"),
        True,
    ),
    "go": Grammar(
        _rules(
            ("method", r"^func[ \t]*\([ \t]*(?:\w+[ \t]+)?\*?(?P<recv>\w+)(?:\[[^\]]*\])?[ \t]*\)[ \t]*(?P<name>\w+)"),
            ("function", rf"^func[ \t]+{_N}"),
            ("struct", rf"^[ \t]*(?:type[ \t]+)?{_N}(?:\[[^\]]*\])?[ \t]+struct\b"),
            ("interface", rf"^[ \t]*(?:type[ \t]+)?{_N}(?:\[[^\]]*\])?[ \t]+interface\b"),
            ("type_alias", rf"^type[ \t]+{_N}[ \t]+=?[ \t]*(?!struct\b|interface\b)[\w*\[\].]+"),
        ),
        (re.compile(r"^import[ \t]+(?:\w+[ \t]+)?(\"[^\"]+\")", re.MULTILINE), re.compile(r"(?<=[(\n])[ \t]*(?:[\w.]+[ \t]+)?(\"[^\"\n]+\")[ \t]*(?=\n)")),
        "capital",
        (),
    ),
    "java": Grammar(
        _rules(
            ("interface", rf"{_MODS}@?\binterface[ \t]+{_N}(?:<[^{{]*?>)?(?:\s+extends\s+(?P<impl>[\w.,<> \t]+?))?(?=\s*\{{)"),
            ("class", rf"{_MODS}\bclass[ \t]+{_N}{_HERITAGE_JAVA}(?=\s*\{{)"),
            ("struct", rf"{_MODS}\brecord[ \t]+{_N}{_HERITAGE_JAVA}(?=\s*\{{)"),
            ("enum", rf"{_MODS}\benum[ \t]+{_N}(?:\s+implements\s+(?P<impl>[\w.,<>\s]+?))?(?=\s*\{{)"),
            ("method", rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}(?:<[^>]*>[ \t]*)?(?!(?:return|new|else|throw|package|import)\b){_RETURN}(?P<name>[A-Za-z_]\w*)[ \t]*\([^;{{}}]*\)[^;{{}}=]*(?=\{{|;)"),
            ("method", rf"^[ \t]*{_MODS}(?P<name>[A-Z]\w*)[ \t]*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)"),
        ),
        (re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)[ \t]*;", re.MULTILINE),),
        "public",
        ("this", "super"),
        True,
    ),
    "c": Grammar(
        _rules(
            ("struct", rf"\b(?:struct|union)[ \t]+{_N}(?=\s*\{{)"),
            ("enum", rf"\benum[ \t]+{_N}(?=\s*\{{)"),
            ("type_alias", rf"\btypedef\b[^;{{}}]*?\b{_N}[ \t]*(?=;)"),
            ("function", r"^[ \t]*(?!(?:return|else|if|while|for|switch|typedef|case|goto)\b)(?P<mods>(?:static|extern|inline)[ \t]+)*[A-Za-z_][\w \t*]*?[ \t*](?P<name>(?!(?:if|while|for|switch)\b)[A-Za-z_]\w*)[ \t]*\([^;{}]*\)\s*(?=\{)"),
        ),
        (re.compile(r"^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"\n]*[>\"])", re.MULTILINE),),
    ),
    "cpp": Grammar(
        _rules(
            ("namespace", rf"\bnamespace[ \t]+(?P<name>[A-Za-z_][\w:]*)(?=\s*\{{)"),
            ("class", rf"\bclass[ \t]+{_N}(?:[ \t]+final)?(?:\s*:\s*(?P<base>[\w:,<> \t]+?))?(?=\s*\{{)"),
            ("struct", rf"\b(?:struct|union)[ \t]+{_N}(?:\s*:\s*(?P<base>[\w:,<> \t]+?))?(?=\s*\{{)"),
            ("enum", rf"\benum[ \t]+(?:class[ \t]+|struct[ \t]+)?{_N}(?:\s*:\s*\w+)?(?=\s*\{{)"),
            ("type_alias", rf"\busing[ \t]+{_N}[ \t]*="),
            ("type_alias", rf"\btypedef\b[^;{{}}]*?\b{_N}[ \t]*(?=;)"),
            ("function", r"(?:^|(?<=[{};]))[ \t]*(?!(?:return|else|if|while|for|switch|typedef|case|goto|using|namespace|class|struct|new|delete|throw)\b)(?P<mods>(?:static|virtual|inline|explicit|constexpr|extern)[ \t]+)*(?:[A-Za-z_][\w:<>,&* \t]*?[ \t*&])?(?P<recv>(?:[A-Za-z_]\w*::)+)?(?P<name>~?(?!(?:if|while|for|switch|catch)\b)[A-Za-z_]\w*)[ \t]*\([^;{}]*\)[^;{}()=]*(?::[^;{}]*)?(?=\{)"),
        ),
        (re.compile(r"^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"\n]*[>\"])", re.MULTILINE),),
        "all",
        ("this",),
        True,
    ),
    "csharp": Grammar(
        _rules(
            ("namespace", r"\bnamespace[ \t]+(?P<name>[A-Za-z_][\w.]*)"),
            ("class", rf"{_MODS}\b(?:class|record)[ \t]+{_N}{_COLON}(?=\s*(?:\{{|where\b))"),
            ("struct", rf"{_MODS}\bstruct[ \t]+{_N}{_COLON}(?=\s*\{{)"),
            ("interface", rf"{_MODS}\binterface[ \t]+{_N}{_COLON}(?=\s*\{{)"),
            ("enum", rf"{_MODS}\benum[ \t]+{_N}(?=\s*[:{{])"),
            ("method", rf"(?:^|(?<=[{{;}}\]]))[ \t]*{_MODS}(?!(?:return|new|else|throw|await|using|namespace|var)\b){_RETURN}(?P<name>[A-Za-z_]\w*)[ \t]*(?:<[^>(]*>)?\([^;{{}}]*\)[^;{{}}=]*(?=\{{|=>|;)"),
            ("method", rf"^[ \t]*{_MODS}(?P<name>[A-Z]\w*)[ \t]*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)"),
        ),
        (re.compile(r"^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;", re.MULTILINE),),
        "public",
        ("this", "base"),
        True,
    ),
    "php": Grammar(
        _rules(
            ("namespace", r"\bnamespace[ \t]+(?P<name>[\w\\]+)"),
            ("class", rf"{_MODS}\bclass[ \t]+{_N}(?:\s+extends\s+(?P<base>[\w\\]+))?(?:\s+implements\s+(?P<impl>[\w\\,\s]+?))?(?=\s*\{{)"),
            ("class", rf"\btrait[ \t]+{_N}(?=\s*\{{)"),
            ("interface", rf"\binterface[ \t]+{_N}(?:\s+extends\s+(?P<impl>[\w\\,\s]+?))?(?=\s*\{{)"),
            ("enum", rf"\benum[ \t]+{_N}(?=\s*[:{{])"),
            ("function", rf"{_MODS}\bfunction[ \t]+&?{_N}"),
        ),
        (re.compile(r"^[ \t]*use[ \t]+([\w\\]+)[^;{(]*;", re.MULTILINE),),
        "not_private",
        ("$this", "self", "static", "parent"),
        True,
    ),
    "swift": Grammar(
        _rules(
            ("class", rf"{_MODS}\b(?:class|actor)[ \t]+(?!func\b|var\b){_N}{_COLON}(?=\s*(?:\{{|where\b))"),
            ("struct", rf"{_MODS}\bstruct[ \t]+{_N}{_COLON}(?=\s*(?:\{{|where\b))"),
            ("enum", rf"{_MODS}\b(?:indirect[ \t]+)?enum[ \t]+{_N}{_COLON}(?=\s*\{{)"),
            ("protocol", rf"{_MODS}\bprotocol[ \t]+{_N}{_COLON}(?=\s*\{{)"),
            ("namespace", rf"\bextension[ \t]+(?P<name>[\w.]+){_COLON}(?=\s*(?:\{{|where\b))"),
            ("function", rf"{_MODS}\bfunc[ \t]+{_N}"),
            ("function", rf"{_MODS}\b(?P<name>init)[?!]?[ \t]*(?=[(<])(?=[^{{}};]*\{{)"),
        ),
        (re.compile(r"^[ \t]*import[ \t]+([\w.]+)", re.MULTILINE),),
        "not_private",
        ("self", "super"),
    ),
    "kotlin": Grammar(
        _rules(
            ("interface", rf"{_MODS}\binterface[ \t]+{_N}{_COLON}(?=\s*(?:\{{|$))"),
            ("enum", rf"\benum[ \t]+class[ \t]+{_N}"),
            ("class", rf"{_MODS}(?<!enum )\bclass[ \t]+{_N}{_COLON}(?=\s*(?:\{{|$))"),
            ("class", rf"{_MODS}(?<!companion )\bobject[ \t]+{_N}{_COLON}(?=\s*(?:\{{|$))"),
            ("function", rf"{_MODS}\bfun[ \t]+(?:<[^>]*>[ \t]*)?(?:[\w.<>?]+\.)?{_N}"),
        ),
        (re.compile(r"^[ \t]*import[ \t]+([\w.*]+)", re.MULTILINE),),
        "not_private",
        ("this", "super"),
    ),
    "dart": Grammar(
        _rules(
            ("class", rf"{_MODS}\b(?:class|mixin)[ \t]+{_N}(?:<[^{{]*?>)?(?:\s+extends\s+(?P<base>[\w<>]+))?(?:\s+(?:with|on)\s+[\w<>, \t]+?)?(?:\s+implements\s+(?P<impl>[\w<>, \t]+?))?(?=\s*\{{)"),
            ("enum", rf"\benum[ \t]+{_N}(?=\s*\{{)"),
            ("function", rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}(?!(?:return|new|else|throw|await|import|var|final)\b)(?:[A-Za-z_][\w<>,? \t]*?[ \t>?])(?P<name>[A-Za-z_]\w*)[ \t]*\([^;{{}}]*\)[ \t]*(?:async\*?[ \t]*)?(?=\{{|=>)"),
        ),
        (re.compile(r"^[ \t]*import[ \t]+([\"'][^\"'\n]*[\"'])", re.MULTILINE),),
        "underscore",
        ("this", "super"),
        True,
    ),
}
GRAMMARS["typescript"] = GRAMMARS["javascript"]
KEYWORDS = _KEYWORDS
