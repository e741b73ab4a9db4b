"""Column functions: doc comments, spans and positions, expression texts."""
