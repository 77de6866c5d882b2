"""Expressions, predicates, file skipping and the deletion-vector codec."""
