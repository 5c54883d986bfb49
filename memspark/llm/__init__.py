"""Operators for text and vectors of training data; nothing else imports this package."""
