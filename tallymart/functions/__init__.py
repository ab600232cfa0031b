"""Column functions: match keys, statistics, report keys, fingerprints."""
