"""Training-data operators: deduplication, decontamination, scoring, sharding, tokenising.

Nothing outside this subpackage imports it.  ``siteatlas.llm.queries`` has the
registered queries and ``siteatlas.llm.oracles`` their SQL.
"""
