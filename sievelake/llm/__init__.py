"""Training-data operators: ten corpus filters and transforms, one module each."""
