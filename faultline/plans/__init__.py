"""Named query plans over the test tables, with their SQL counterparts."""
