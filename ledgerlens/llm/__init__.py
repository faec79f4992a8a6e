"""Training-data operators: ten corpus-scale operators and the queries built on them."""
