"""Incremental runs of the batch jobs."""
