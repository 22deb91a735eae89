"""Datasets on shared storage."""
