"""DataFrame operators on samples, calls and matrices."""
