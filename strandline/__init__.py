"""Strandline: relation, text and vector analytics written for Spark's DataFrame API."""
