"""Spark jobs that curate, split, featurize, triage and score corpora of program/test-suite tasks."""
