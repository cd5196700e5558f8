"""DataFrame -> DataFrame operators of the alerting pipeline."""
