"""Registered queries over the test data's tables, with their SQL."""
