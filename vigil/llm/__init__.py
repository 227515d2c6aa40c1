"""Operators for preparing training text at scale. Nothing outside this folder imports it."""
