"""Vector similarity search and its data processing as DataFrame plans."""
