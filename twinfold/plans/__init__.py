"""plans of twinfold."""
