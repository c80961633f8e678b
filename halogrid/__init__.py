"""Analytics over simulation catalogs (halos, particles, meshes, mocks) as Spark plans."""
