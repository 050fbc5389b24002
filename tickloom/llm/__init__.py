"""Training-data operators: text, pages, vectors and media columns. Nothing else in the package imports this."""
