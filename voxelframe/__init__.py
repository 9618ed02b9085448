"""Quantitative-imaging analytics as Spark jobs: voxels, masks, texture, feature quality, splits, scoring."""
