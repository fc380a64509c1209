"""From mappings to DataFrame plans."""
