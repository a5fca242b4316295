"""Column functions: expressions only, no user functions unless a module says so."""
