"""Functions of the code and document graph."""
