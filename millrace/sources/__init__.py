"""Readers and writers: manifests, Markdown folders, query sets, index tables and reports."""
