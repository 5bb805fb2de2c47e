"""Readers that turn repositories, working copies and stored collections into DataFrames."""
