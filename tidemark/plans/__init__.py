"""Named queries built from the operators and the SQL front end."""
