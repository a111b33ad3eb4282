"""Value types, text forms and predicates as column expressions."""
