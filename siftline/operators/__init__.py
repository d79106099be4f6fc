"""DataFrame operators: ratchet, gates, vetoes, rules, roots, coverage, ledger, grading."""
