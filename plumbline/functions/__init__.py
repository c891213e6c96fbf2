"""Column builders and decoders."""
