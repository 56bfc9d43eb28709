"""Training-data operators: quality, dedup, decontamination, mixing, sharding and the like."""
