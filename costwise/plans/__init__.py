"""Registered query plans (one per operator family of the survey) and their SQL oracles."""

from costwise.plans import economics  # noqa: F401  (registration order: economics before reports)
from costwise.plans import audits, evidence, io, ladder, reports, rowrules, scoring, streaming, synthesis  # noqa: F401
from costwise.plans.common import REGISTRY, Plan  # noqa: F401


def queries():
    return {name: p.run for name, p in REGISTRY.items()}


def oracle_sql():
    return {name: p.oracle for name, p in REGISTRY.items() if p.oracle}
