"""Part of loomlake."""
