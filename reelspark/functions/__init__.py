"""Column builders: names, timecode, units and audio arithmetic."""
