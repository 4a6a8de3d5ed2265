"""Training-data operators: ten corpus-scale steps, independent of the rest of the library."""
