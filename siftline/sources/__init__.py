"""Readers: SARIF logs, baselines, coverage, manifests, repository trees."""
