"""Cost, access rules, introspection and usage."""
