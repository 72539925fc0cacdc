"""Sources: format detection and parsers from bytes to books and sections."""
