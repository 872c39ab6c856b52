"""Planning, recovery and report pipelines built from operators."""
