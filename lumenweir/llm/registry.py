"""The opN queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lumenweir.llm import chat, exact, mixing, near, packing, phrases, quality, secrets, sites, substrings, suffixes, tokens, trie

MODULES = (near, quality, tokens, mixing, secrets, packing, substrings, chat, exact, sites, phrases, trie, suffixes)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
