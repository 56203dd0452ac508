"""Fixed rules of the known sources, as small tables. All entries are fixed values."""
