"""Scans, canonical frames and sinks."""
