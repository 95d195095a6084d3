"""Facts from tables that grow while they are read."""
