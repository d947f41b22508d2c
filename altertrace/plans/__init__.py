"""Plan building blocks: hot-group-safe ordering, checked lookups, lineage cuts."""
