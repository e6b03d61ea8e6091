"""Operators on images (tables keyed by voxel), label maps, meshes, maps of units, rays and hierarchies."""
