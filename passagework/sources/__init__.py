"""Sources and sinks: folders, encodings, evaluation sets, snapshots and the driver's tables."""
