"""Operators for building training corpora. Nothing else imports this."""
