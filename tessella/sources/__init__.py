"""Readers of the pipeline's files and writers of its exports."""
