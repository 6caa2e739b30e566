"""Training-data operators: ten jobs over a table of documents, each a function from DataFrame to DataFrame."""
