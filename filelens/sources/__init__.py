"""File-system sources and the versioned index store."""
