"""Frames derived from the driver tables, registered queries and their DuckDB oracle SQL."""
