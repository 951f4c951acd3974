"""Tables behind the sources of a catalog."""
