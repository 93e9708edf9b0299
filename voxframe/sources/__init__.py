"""Readers and writers: chunked volumes, point lists, detections, checkpoints."""
