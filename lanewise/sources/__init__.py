"""Readers of trace and matrix files."""
