"""Readers and writers of reports and verdicts."""
