"""Report rendering and file output."""
