"""Operators a training-data pipeline needs: extraction, filtering, deduplication,
mixing, packing, counting, fingerprints and sharding.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; :mod:`formloom.llm.queries` registers the thin queries.
"""
