"""Document and value functions: plain Python for one document, native columns where Catalyst can express them."""
