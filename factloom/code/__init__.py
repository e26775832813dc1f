"""PHP source code as tables of facts."""
