"""Training-data operators: packing, PII, deduplication, scoring and tokenizing of document tables.

Each operator module has a general interface (``docs`` is any table with
``doc_id`` and ``text``; other columns, also ones whose names clash with
results, are ignored) and ``queries.py`` holds the thin registered queries.
"""
