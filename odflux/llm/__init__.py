"""Training-data operators: sharding, filtering, joining, scoring, packing and encoding of text tables."""
