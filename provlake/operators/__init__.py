"""Operators over a MetadataStore: every one is lazy and returns DataFrames."""
