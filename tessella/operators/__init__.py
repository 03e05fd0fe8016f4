"""DataFrame-to-DataFrame operators over grids, point clouds, series and drainage graphs."""
