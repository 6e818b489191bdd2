"""Operators for preparing language-model training data; nothing else imports this subpackage."""
