"""Larder: a PySpark engine for packed small-object archives and the control plane around them."""
