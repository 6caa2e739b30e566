"""Column functions: text, identifiers, formats and small rules, all inside Catalyst."""
