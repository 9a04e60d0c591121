"""Column functions: everything here is an expression that Catalyst plans."""
