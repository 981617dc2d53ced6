"""Column functions: names, text, classification, dates, vectors, fuzzy scores."""
