"""Operators over documents, findings, history and evaluation runs."""
