"""Training-data pipeline operators: filtering, deduplication, mixing and packing.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries and their SQL.
"""
