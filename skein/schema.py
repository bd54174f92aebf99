"""Tables of the engine: explicit schemas, enumerations and the confidence order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "file_id int, path string, language string, loc int, sha string"
SYMBOLS = "symbol_id int, file_id int, name string, kind string, signature string, start_line int, end_line int, exported boolean"
EDGES = "src int, dst int, kind string, weight long, confidence string"
IMPORTS = "path string, language string, spec string"
CALLS = "file_id int, callee string, line int"
CHANGES = "path string, kind string, seq long"

EDGE_KINDS = ("Import", "Call", "Inherit", "Namespace", "Pair")
SYMBOL_KINDS = ("Function", "Method", "Class", "Struct", "Interface", "Trait", "Enum", "Type", "Const", "Module", "Field", "Variable")
CONTAINER_KINDS = ("Class", "Interface", "Struct", "Enum", "Trait", "Module")
#: From the surest to the least sure.
CONFIDENCE = ("Exact", "Scoped", "Syntactic", "Unknown")


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), c)


def weakest(c: Column) -> Column:
    """Aggregate: the least sure of a group's confidences."""
    return F.max_by(c, confidence_rank(c))
