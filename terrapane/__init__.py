"""Gridded-panel analytics on Spark: cubes of cells and times to panels of regions and periods."""
