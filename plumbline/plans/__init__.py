"""Rule catalogue, configuration, runs and reports."""
