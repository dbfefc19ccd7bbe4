"""Readers and writers of event logs, rankings, profiles and evidence."""
