"""End-to-end jobs: training, scoring, search, batches."""
