"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``; nothing else imports them."""
