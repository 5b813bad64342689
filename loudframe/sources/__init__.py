"""Reading files, packets and catalogs; writing reports."""
