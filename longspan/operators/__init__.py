"""longspan operators package."""
