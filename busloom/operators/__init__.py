"""Stages of the analysis, each a function from DataFrame to DataFrame."""
