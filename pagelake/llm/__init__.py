"""Training-data operators: filters, deduplication, mixing, sharding, archives."""
