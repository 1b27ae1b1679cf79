"""Training-data operators for very large corpora, each built by a method of its own."""
