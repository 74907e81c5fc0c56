"""The engine's tables as derived from the supplied star schema, and queries over them."""
