"""Training-data operators. One module per operator; ``queries`` registers them."""
