"""Registered queries: adapters from the test tables, operators on them, and DuckDB SQL that says the same."""
