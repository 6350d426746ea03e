"""Training-data operators: one module an operator, each with a general function and a thin query."""
