"""Readers, writers and the stand-ins that the driver's tables give."""
