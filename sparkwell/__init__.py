"""sparkwell: retrieval and text analytics as ordinary DataFrame work."""
