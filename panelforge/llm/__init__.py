"""Training-text operators. Nothing outside this subpackage imports it."""
