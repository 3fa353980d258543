"""Readers and writers for raw records, tables and zone layers."""
