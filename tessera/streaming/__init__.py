"""Event streams: windows in batch and streaming form, and an appending sink."""
