"""Column functions: text clean-up, tokens, similarity and text statistics."""
