"""longspan plans package."""
