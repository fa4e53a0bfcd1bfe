"""Input: file listings, capture times and manifests; output: delimited files."""
