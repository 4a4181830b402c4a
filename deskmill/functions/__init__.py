"""See README.md, section Layout."""
