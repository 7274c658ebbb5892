"""Query registry and what a session needs to run it."""
