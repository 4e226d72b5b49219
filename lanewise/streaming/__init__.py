"""Trace files as a stream."""
