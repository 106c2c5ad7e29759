"""Column functions: text, identities, names and extracted records."""
