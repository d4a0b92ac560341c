"""Readers and writers: library tables, raw files, provider JSON/XML."""
