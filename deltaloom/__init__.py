"""Code-review analytics as composable DataFrame transformations."""
