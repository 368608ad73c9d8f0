"""Operators for preparing training text and vectors at scale. Nothing outside this folder imports it."""
