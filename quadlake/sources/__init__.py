"""Readers of tables, virtual quad views and quad text formats."""
