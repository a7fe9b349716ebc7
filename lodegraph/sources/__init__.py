"""Readers and writers for metadata tables, schema CSV files and source trees."""
