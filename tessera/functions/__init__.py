"""Column functions: text, numbers, normalisers and year-less dates. All take and return Columns."""
