"""Row-level column expressions; all of them stay inside the JVM."""
