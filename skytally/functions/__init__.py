"""Column expressions: geometry, sky pixels, photometry, cosmology."""
