"""Gleaner: document indexing and retrieval as Spark DataFrame jobs."""
