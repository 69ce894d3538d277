"""Column functions: text, URLs, hashes, vectors."""
