"""Training-data operators: one module each, with their queries and SQL. Nothing else in the library imports them."""
