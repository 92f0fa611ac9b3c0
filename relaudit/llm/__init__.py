"""Training-data operators: ten numbered operators and what they share. Nothing else in the package imports this."""
