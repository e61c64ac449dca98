"""From files to tables and from SQL text to rows."""
