"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from popweave.llm import decontamination, jaccard_join, licenses, line_dedup, lm_scoring, mixing, resampling, token_files, toxicity, url_filters, vector_codes, warc, winnowing

MODULES = [mixing, jaccard_join, toxicity, decontamination, lm_scoring, token_files, line_dedup, warc, url_filters, winnowing, vector_codes, licenses, resampling]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
