"""Readers and writers for events, files, reports, traces and decisions."""
