"""Training-data operators: one module per operator, one thin query per module in ``queries``."""
