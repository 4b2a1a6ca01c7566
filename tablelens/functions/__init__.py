"""Per-row and per-value expressions: types, canonical text, parsing."""
