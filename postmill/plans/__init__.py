"""Batch jobs and the query registry."""
