"""Operators for preparing language-model training data; nothing else in ribolens imports this package."""
