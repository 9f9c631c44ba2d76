"""sources of twinfold."""
