"""Reusable Column builders (all JVM-side, no Python UDFs)."""
