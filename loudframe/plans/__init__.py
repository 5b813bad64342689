"""User-facing compositions: gain plans and reports."""
