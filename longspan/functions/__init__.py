"""longspan functions package."""
