"""Training-data operators: search, deduplication, filters, classifiers, sharding, packing and mixing."""
