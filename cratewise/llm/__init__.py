"""Training-data operators: tokens, fingerprints, classifiers, deduplication, privacy."""
