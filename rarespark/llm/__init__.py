"""Operators for preparing training text, one module each; ``registry`` lists their queries."""
