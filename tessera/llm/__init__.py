"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
of :mod:`tessera.llm.entry` are what the driver contract file adds.
"""
