"""soundlake: analytics over collections of recordings, written as Spark jobs."""
