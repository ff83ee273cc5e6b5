"""Jobs that chain operators with sources and sinks."""
