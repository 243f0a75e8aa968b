"""Text analysis as column expressions."""
