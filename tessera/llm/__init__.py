"""Operators on language-model training data.  Nothing outside this subpackage imports it."""
