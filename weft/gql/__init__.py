"""Operation and schema text: syntax, validation, normalisation."""
