"""Column functions: vector math, quantisation, tokens."""
