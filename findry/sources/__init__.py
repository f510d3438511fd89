"""Readers and writers for passages, queries, judgements, examples and vectors."""
