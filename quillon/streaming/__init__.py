"""Incremental runs: dependency edges, closure, scope, and checks on arriving tables."""
