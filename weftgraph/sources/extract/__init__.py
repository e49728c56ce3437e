"""Symbols, containment and references of source files: one table function over a frame of files."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import blocks, others, routes
from .grammar import GRAMMARS
from .model import Extraction

log = logging.getLogger(__name__)

EXTRACTORS = {
    **{language: blocks.extract for language in GRAMMARS},
    "python": others.extract_python,
    "ruby": others.extract_ruby,
    **{language: others.extract_lisp for language in ("elisp", "commonlisp", "scheme")},
    **{language: others.extract_component for language in ("svelte", "vue")},
}

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def _struct(spelled: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in spelled.split(", "))])


NODE = _struct("id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean")
EDGE = _struct("source string, target string, kind string, confidence double")
REF = _struct("source_node_id string, target_name string, kind string, file_path string, receiver_hint string")
ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("parse_errors", T.IntegerType()), T.StructField("parse_missing", T.IntegerType()), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("refs", T.ArrayType(REF))])


def extract_file(path: str, language: str, text: str) -> Extraction | None:
    """Everything found in one file, with its routes; None if the language has no extractor.

    A file that an extractor cannot take (nested deeper than its parser holds, say) gives
    its file node alone, with a parse error, so that one odd file never ends a job.
    """
    extractor = EXTRACTORS.get(language)
    if not extractor:
        return None
    try:
        return routes.append(extractor(path, language, text))
    except Exception as e:
        log.warning("%s was not read: %s", path, type(e).__name__)
        return Extraction(path, language, text, parse_errors=1)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[kind.simpleString()]


def extract(files: DataFrame) -> DataFrame:
    """``path, parse_errors, parse_missing, nodes, edges, refs`` of files with ``path, language, text``; one row per file."""
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found = extract_file(path, language, text or "")
                if found:
                    row = dict(path=path, parse_errors=found.parse_errors, parse_missing=found.parse_missing, nodes=found.nodes, edges=found.edges, refs=found.refs)
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select("path", "language", "text").mapInArrow(run, ROWS)
