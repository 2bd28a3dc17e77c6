"""Column-level functions: text, money, URL, colour, hashing."""
