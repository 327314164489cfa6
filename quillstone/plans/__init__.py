"""Named queries over the registered tables, with their SQL counterparts."""
