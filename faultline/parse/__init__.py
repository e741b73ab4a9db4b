"""Source parser: tokens, statements, fact rows."""
