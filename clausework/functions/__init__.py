"""Expressions that operators share."""
