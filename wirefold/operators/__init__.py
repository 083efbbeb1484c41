"""Part of wirefold."""
