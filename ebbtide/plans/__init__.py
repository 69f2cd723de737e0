"""Named queries composed from the operators, each with its SQL statement."""
