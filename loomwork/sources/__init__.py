"""Sources: page corpora in the snapshot shape."""
