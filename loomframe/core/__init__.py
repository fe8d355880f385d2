"""Session helpers, keyed randomness and global ordering."""
