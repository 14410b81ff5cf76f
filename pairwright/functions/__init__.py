"""Column-level functions (``Column -> Column``)."""
