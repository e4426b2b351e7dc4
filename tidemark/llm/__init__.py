"""Training-data operators: ten Spark jobs over documents, embeddings and conversations."""
