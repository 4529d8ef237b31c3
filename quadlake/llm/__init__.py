"""Operators for training data: heavy items, distinct counts, formatting
copies, tokens, mixtures and repetition. Nothing outside imports this."""
