"""Spark-native analytics over point clouds, laser pulses, rasters and voxels."""
