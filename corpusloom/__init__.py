"""Corpusloom: a PySpark engine for building, querying and evaluating document-retrieval corpora."""
