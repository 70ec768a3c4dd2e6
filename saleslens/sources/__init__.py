"""Table schemas, loaders and sinks."""
