"""The query catalogue: each module has QUERIES and ORACLE."""

from codeloom.plans import graphs, indexing, reports, retrieval, symbols, training

CATALOGUES = [retrieval, indexing, graphs, reports, symbols, training]
