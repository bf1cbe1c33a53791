"""Governance analytics over code, requirements, policies and access rules, as Spark plans."""
