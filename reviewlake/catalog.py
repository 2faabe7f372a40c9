"""The queries of this library by name, each with its SQL oracle where SQL can express it."""

from .plans import queries_files, queries_review, queries_sources

QUERIES = {**queries_files.QUERIES, **queries_review.QUERIES, **queries_sources.QUERIES}
ORACLES = {**queries_files.ORACLES, **queries_review.ORACLES, **queries_sources.ORACLES}
#: Every review with its five most relevant files.
FLAGSHIP = QUERIES["relevant_files_top5"]
