"""Relational operators over cells, artifacts, documents and plans. All take and return DataFrames."""
