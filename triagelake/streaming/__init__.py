"""Scan events as a stream: counts of windows, kept up by what arrives."""
