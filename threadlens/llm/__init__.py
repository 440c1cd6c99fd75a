"""Operators for preparing training text: sharding, scans, packing, scoring, filters, dedup.

Nothing outside this package imports it.  Each module holds one operator with a general
interface; ``catalog`` holds the thin registered queries and their DuckDB SQL.
"""
