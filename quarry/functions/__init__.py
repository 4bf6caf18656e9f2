"""Column functions: text and contact normalisation, HTML extraction, geometry, scores."""
