"""Column functions: text forms of values, similarity, phonetics, money and redaction."""
