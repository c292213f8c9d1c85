"""Training-data operators: packing, sharding, scanning, deduplication, scoring.  Nothing outside imports this."""
