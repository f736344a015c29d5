"""Named analyses over the operators."""
