"""Readers and writers of case corpora, manifests and file trees."""
