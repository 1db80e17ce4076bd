"""Reusable DataFrame operators: ranking without a single-partition window, mode per key, weighted joins."""
