"""Change-log streaming and access statistics."""
