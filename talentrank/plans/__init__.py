"""Whole plans: providers of model calls, the match run, the ingestion batch."""
