"""Registered queries; importing this package fills the register."""

from . import asking, changes, graph, languages, reports, search, sources, symbols  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
