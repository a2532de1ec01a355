"""Training-data operators: sharding, de-duplication, quality, formatting, tokenising, scanning."""
