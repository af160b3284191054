"""Column functions shared by batch and streaming plans."""
