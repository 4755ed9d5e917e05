"""DataFrame -> DataFrame computations, one module per topic."""
