"""Column builders: text, locale, intent and geo functions."""
