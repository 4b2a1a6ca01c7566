"""Input sources."""
from .readers import csv_scan, detect_format, hash_sample, load, load_checked, positional_columns, preview, sample, tsv_to_csv

__all__ = ["csv_scan", "detect_format", "hash_sample", "load", "load_checked", "positional_columns", "preview", "sample", "tsv_to_csv"]
