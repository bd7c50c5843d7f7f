"""Readers and writers of point-cloud, scene and hand files."""
