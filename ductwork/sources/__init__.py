"""Readers and writers: feature collections, rules, driver tables."""
