"""Registered queries: the operators over records made of the sample tables."""
