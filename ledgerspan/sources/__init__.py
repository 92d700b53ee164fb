"""Readers and writers: filing documents, tables, notes, snapshots, and exported marts."""
