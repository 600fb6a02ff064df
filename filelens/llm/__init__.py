"""Training-data operators: each module is one operator, ``registry`` names the queries."""
