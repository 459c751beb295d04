"""Part of the tracewarden engine."""
