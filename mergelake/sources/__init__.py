"""The versioned store, and change feeds in files."""
