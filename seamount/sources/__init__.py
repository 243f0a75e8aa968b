"""Readers and writers of text collections, judgments, runs and indexes."""
