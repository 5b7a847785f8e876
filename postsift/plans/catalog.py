"""Imports every module of registered queries."""

from postsift.plans import q_applications, q_dedup, q_flows, q_hygiene, q_ingest, q_reports, q_rules, q_sinks, q_text  # noqa: F401
from postsift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
