"""Personal data in text columns: found, masked and restored with DataFrame operations."""
