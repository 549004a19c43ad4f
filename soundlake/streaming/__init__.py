"""The same questions over streams of files and play events."""
