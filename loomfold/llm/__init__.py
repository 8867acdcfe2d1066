"""Operators for text used in training; nothing outside this folder imports it."""
