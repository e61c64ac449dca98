"""The line parsers on streams."""
