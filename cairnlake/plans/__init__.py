"""Ingestion plans, the named query catalog and its SQL oracles."""
