"""Functions over voxels, labels, meshes, maps and predictions as DataFrames."""
