"""Operators that prepare document collections as training data.  Nothing outside this folder imports it."""
