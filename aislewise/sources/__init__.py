"""Relations, readers and sinks."""
