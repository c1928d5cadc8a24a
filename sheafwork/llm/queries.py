"""The queries of this subpackage and the SQL that says the same."""

from . import exact_dedup, html_text, mixing, quality, sharding, simhash, substring_dedup, tokens, warc

MODULES = (exact_dedup, html_text, mixing, quality, sharding, simhash, substring_dedup, tokens, warc)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
