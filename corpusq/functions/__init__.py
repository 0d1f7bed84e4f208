"""Column functions: text, vectors, estimates."""
