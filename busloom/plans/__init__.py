"""Whole analyses, put together from sources, operators and sinks."""
