"""Reading and writing tables, vocabularies and definitions."""
