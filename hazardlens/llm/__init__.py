"""Training-data operators: tokenising, duplicate search, mixing, filtering and scanning of text tables."""
