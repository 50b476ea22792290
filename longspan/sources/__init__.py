"""longspan sources package."""
