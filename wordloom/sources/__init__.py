"""Tables in files: corpus, texts, index."""
