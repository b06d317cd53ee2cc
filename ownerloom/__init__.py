"""Spark jobs that compare, merge and report on revisions of documents, as tables."""
