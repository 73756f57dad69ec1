"""Whole jobs: check suites, suggestions, findings, reports, guarded runs."""
