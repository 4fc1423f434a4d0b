"""sparkscrub: profile, check, clean, join and describe tables with PySpark."""
