"""Training-data operators: mixing, de-duplication, quality, extraction,
packing and sharding of document corpora, each a Spark job over whole tables."""
