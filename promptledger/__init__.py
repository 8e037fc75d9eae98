"""Prompt guardrails and audit statistics as Spark jobs.

Everything here maps DataFrames to DataFrames: request bodies become prompts,
prompts become findings and decisions, decisions become an audit ledger, and
the ledger becomes cost and security statistics.
"""
