"""Report sinks and read-back."""
