"""Training-data operators over a ``documents`` table (doc_id, text, ...)."""
