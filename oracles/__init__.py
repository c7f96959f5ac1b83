"""DuckDB SQL that states what each named query must return."""

from oracles.statements import ORACLES

__all__ = ["ORACLES"]
