"""Training-data operators: packing, deduplication, filtering, extraction and masking of large text corpora."""
