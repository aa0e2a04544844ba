"""Query plans: representation, recording, source text, rewrites and authoring."""
