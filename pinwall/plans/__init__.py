"""Registered queries: each module pairs DataFrame plans with their DuckDB SQL."""
