"""Training-data operators: packing, token counts, language identification,
exact and near deduplication, HTML extraction, byte-level BPE, fingerprints,
secret scans and sharding. Nothing else in the library imports this package."""
