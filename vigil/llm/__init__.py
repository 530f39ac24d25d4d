"""Training-data operators (deduplication, mixing, classifiers, tokenising).

Nothing else in the library imports this subpackage."""
