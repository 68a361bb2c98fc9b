"""Scans of images, boxes and markers."""
