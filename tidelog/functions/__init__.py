"""Column functions: time, log-line parsing, regular expressions, path templates."""
