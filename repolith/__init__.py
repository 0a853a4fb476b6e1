"""repolith: repository-history analytics over a fleet of source repositories, on Spark."""
