"""Duplicate and similarity analytics over catalogs of files, on Spark."""
