"""Operators over DataFrames of chunks, entities, relations and graphs."""
