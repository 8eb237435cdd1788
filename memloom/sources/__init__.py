"""Table loaders."""
