"""Spark jobs that structure, align and score records extracted from documents."""
