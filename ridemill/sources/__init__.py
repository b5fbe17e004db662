"""Scans, sinks, dimensions and change detection."""
