"""Reports over a whole star, and the registered queries over the driver's tables."""
