"""hubbub: batch and streaming jobs that explain what a live audience reacts to."""
