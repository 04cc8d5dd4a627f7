"""Named queries over a set of tables, and their plain-SQL twins."""
