"""Sources beside tables: folders of source files, configurations."""
