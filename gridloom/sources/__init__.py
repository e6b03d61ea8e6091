"""Tables as images, meshes, label maps and frames; volume and transfer-function files."""
