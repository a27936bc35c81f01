"""Where messages and orders come from, and where they go."""
