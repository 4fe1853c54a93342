"""Training-data operators: text, packing and selection."""
