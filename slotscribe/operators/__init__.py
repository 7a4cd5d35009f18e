"""DataFrame operators: registry, transaction normalising, routing, decoding, deduplication, lookups."""
