"""operators of twinfold."""
