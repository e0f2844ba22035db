"""Operators for training corpora, and their queries; nothing else imports this."""
