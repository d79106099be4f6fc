"""Plans over registered tables, and their SQL."""
