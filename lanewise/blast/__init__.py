"""Reports of sequence searches."""
