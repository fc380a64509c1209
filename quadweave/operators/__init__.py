"""Expressions and DataFrame operators over terms and statements."""
