"""Readers, writers, the dataset catalog and stored models."""
