"""Assembly of the profiling passes into report plans."""
