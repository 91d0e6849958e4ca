"""The library works on bounded tables only; there is nothing to stream, and so nothing here."""
