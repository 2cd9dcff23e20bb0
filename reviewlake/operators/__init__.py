"""DataFrame operators, one module per stage of a review."""
