"""Readers for invoice documents, catalogues and review queues."""
