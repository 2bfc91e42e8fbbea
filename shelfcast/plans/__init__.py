"""Whole runs: operators, sources and sinks put together."""
