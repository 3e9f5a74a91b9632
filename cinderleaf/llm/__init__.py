"""Operators for preparing language-model training data, with their registered queries."""
