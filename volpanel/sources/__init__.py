"""Table scans, sinks and the derived views over the benchmark tables."""
