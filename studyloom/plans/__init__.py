"""Plan building blocks: skew-safe ordered scans, lineage cuts, test-data views."""
