"""Training-data preparation: deduplication, cleaning, labelling and packing of document corpora."""
