"""Column functions: pattern scans with offsets, check digits, language windows, vault keys and encryption."""
