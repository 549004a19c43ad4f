"""Column functions: names and paths, codes, keys, scores, levels and arrays of samples."""
