"""Readers and writers of graph databases and patterns."""
