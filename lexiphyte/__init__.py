"""Standardising scientific names on Spark: parse, match, resolve."""

from lexiphyte.operators.match import match_names
from lexiphyte.operators.parse import parse_names, rejected_names
from lexiphyte.operators.resolve import classify, resolve_names
from lexiphyte.sources.pipe_text import read_parsed, read_taxonomy, write_parsed

__all__ = ["classify", "match_names", "parse_names", "read_parsed", "read_taxonomy", "rejected_names", "resolve_names", "write_parsed"]
