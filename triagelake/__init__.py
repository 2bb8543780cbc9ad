"""Findings, graph and corpus analytics as DataFrame -> DataFrame functions on PySpark."""
