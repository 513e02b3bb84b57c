"""The corpus queries and their SQL, gathered from the operators' modules."""

from lexiphyte.llm import bpe, decontamination, html_text, language, near_duplicates, neighbours, secrets, sharding, token_counts, toxicity

MODULES = (decontamination, neighbours, html_text, toxicity, secrets, token_counts, language, near_duplicates, bpe, sharding)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
