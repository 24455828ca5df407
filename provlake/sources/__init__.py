"""Readers and writers of metadata stores, payloads and side files."""
