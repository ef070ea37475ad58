"""Session settings, derived views and the registered queries."""
