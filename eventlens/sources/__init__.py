"""Readers and writers of event batches, incidents, metrics and models."""
