"""Training-data operators: sharding, quality, scoring, dedup, archives, chat text, tokens."""
