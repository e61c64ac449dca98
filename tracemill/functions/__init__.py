"""Column functions: identifiers, coercion, timestamps, levels, measures."""
