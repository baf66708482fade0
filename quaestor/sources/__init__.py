"""Scans, tables and sinks."""
