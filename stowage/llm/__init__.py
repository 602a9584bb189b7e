"""Training-data operators: thirteen large-scale text, archive, vector and sampling operators over the DataFrame API."""
