"""Training-data operators: filtering, de-duplication, decontamination, masking, encoding."""
