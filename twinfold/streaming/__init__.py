"""streaming of twinfold."""
