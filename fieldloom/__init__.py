"""Spark jobs for regional statistics and text corpora."""
