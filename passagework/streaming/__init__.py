"""Progress of a run, and incremental upkeep as a stream."""
