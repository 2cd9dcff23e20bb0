"""Column functions shared by the operators; all are native expressions."""
