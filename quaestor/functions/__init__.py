"""Column functions: text, vectors, codecs and embedders."""
