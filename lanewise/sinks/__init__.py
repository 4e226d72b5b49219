"""Writers of sequences and tables."""
