"""Operators on DataFrames of terrain, places, paths and map tiles."""
