"""functions of twinfold."""
