"""Questions about a collection, each a DataFrame in and a DataFrame out."""
