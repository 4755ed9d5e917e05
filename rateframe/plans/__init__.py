"""Jobs that chain operators, and the catalogue of named queries."""
