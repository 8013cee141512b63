"""Catalogue queries over the driver's tables with the SQL that must give the same rows."""

from lectern.plans import q_analysis, q_catalogue, q_formats, q_media, q_scalars, q_sources, q_text, q_timed

_PARTS = (q_timed, q_catalogue, q_text, q_formats, q_scalars, q_sources, q_analysis, q_media)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
