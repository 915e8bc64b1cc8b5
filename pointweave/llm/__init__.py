"""Operators for large text-corpus preparation; nothing outside this folder imports it."""
