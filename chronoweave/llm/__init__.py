"""Training-data operators (deduplication, extraction, scoring, mixing, sharding, archives)."""
