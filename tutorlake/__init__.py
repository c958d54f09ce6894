"""Spark jobs for a tutoring knowledge base."""
