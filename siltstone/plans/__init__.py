"""Named step chains over a dictionary of DataFrames."""
