"""Table access and sinks."""
