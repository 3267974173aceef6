"""Training-data operators: chat formatting, vector search, mixing, PII,
near-duplicates, URL and quality filters, line and passage dedup, and
SentencePiece tokenization.  Nothing else in the library imports this
subpackage."""
