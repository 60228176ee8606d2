"""Where log lines and their metadata come from, and where exports go."""
