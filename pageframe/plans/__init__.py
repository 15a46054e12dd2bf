"""Registered queries and their DuckDB SQL, by family."""

from pageframe.plans import budgets, files, intake, layout, pageset, sitecheck, stamps  # noqa: F401
from pageframe.plans.registry import ORACLES, QUERIES  # noqa: F401
