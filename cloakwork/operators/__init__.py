"""Detection, resolution, masking, restoring, evaluation, metrics and generation."""
