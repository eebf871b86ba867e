"""DataFrame -> DataFrame steps of the layers."""
