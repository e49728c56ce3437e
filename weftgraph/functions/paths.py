"""Column expressions for paths: languages, layers, tests, ignored folders."""

from __future__ import annotations

import functools
import operator
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

# File extensions of each language.
EXTENSIONS = {
    "rust": "rs", "python": "py pyi", "go": "go", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "java": "java",
    "c": "c h", "cpp": "cpp cc cxx hpp hxx hh", "elisp": "el", "commonlisp": "lisp cl lsp asd", "scheme": "scm ss sld sls",
    "ruby": "rb", "csharp": "cs", "php": "php", "swift": "swift", "kotlin": "kt kts", "dart": "dart", "svelte": "svelte", "vue": "vue",
}
LANGUAGE_OF = {ext: lang for lang, every in EXTENSIONS.items() for ext in every.split()}
# Folders and name endings that mark tests.
TEST_FOLDERS = "/test/ /tests/ /spec/ /__tests__/".split()
TEST_ENDINGS = "_test.go _test.py _test.rb _spec.rb _test.rs .test.ts .test.tsx .test.js .test.jsx .spec.ts .spec.tsx .spec.js test.java tests.cs test.kt _test.dart".split()
TEST_MODULES = "::tests:: ::test:: .tests. #[test]".split()
# Folders never looked into.
IGNORED = (".git", "node_modules", "target", "dist", "build", ".weftgraph")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    """Language by extension, null if unknown; a map lookup, no join."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*LANGUAGE_OF.items())]), extension(path))


def refined_language(lang: Column, path: Column, text: Column) -> Column:
    """A .h file with marks of C++ is C++."""
    marks = r"class |namespace |template ?<|::"
    return F.when((lang == "c") & (extension(path) == "h") & text.rlike(marks), F.lit("cpp")).otherwise(lang)


def ignored(path: Column) -> Column:
    return path.rlike("/(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def layer(path: Column, root: str = "") -> Column:
    """First folder under the root; files of the root itself are in ``(root)``; other paths in their own first folder."""
    rel = F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)
    rel = F.regexp_replace(rel, "^/+", "")
    return F.when(F.contains(rel, F.lit("/")), F.split(rel, "/")[0]).otherwise(F.lit("(root)"))


def is_test(kind: Column, name: Column, path: Column, qualified: Column) -> Column:
    """A function or method that its path, its name or its module marks as a test."""
    p = ascii_lower(F.translate(path, "\\", "/"))
    some = lambda tests: functools.reduce(operator.or_, tests)
    file = file_name(p)
    by_path = some([F.contains(p, F.lit(x)) for x in TEST_FOLDERS] + [F.startswith(file, F.lit("test_"))] + [F.endswith(file, F.lit(x)) for x in TEST_ENDINGS])
    n = ascii_lower(name)
    by_name = (n == "test") | F.startswith(n, F.lit("test_")) | F.endswith(n, F.lit("_test")) | F.endswith(n, F.lit("_spec"))
    by_module = some([F.contains(ascii_lower(qualified), F.lit(x)) for x in TEST_MODULES])
    return kind.isin("function", "method") & (by_path | by_name | by_module)
