"""Choice of sources and joins."""
