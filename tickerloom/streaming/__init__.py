"""The tick operators on streams."""
