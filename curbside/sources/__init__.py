"""Readers and writers: raw months, stored slices, aggregate tables."""
