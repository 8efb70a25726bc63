"""Traceable batch aggregates and an idempotent event ledger, written as Spark jobs."""
