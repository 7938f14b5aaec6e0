"""Operators for preparing language-model training data, each a DataFrame job over a table of documents."""
