"""Grammars, lexers and the generalised LL recogniser of the supported languages."""
