"""Training-data operators: top items per group, packing, mixing and text quality."""
