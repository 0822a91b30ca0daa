"""Training-data operators: packing, near-dedup, scoring, mixing. Nothing else in the library imports this package."""
