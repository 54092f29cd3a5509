"""Session, shared storage and end-to-end plans."""
