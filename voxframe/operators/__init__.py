"""Relational operators over voxels, points, blocks and detections."""
