"""Censored samples, parametric fits, survival curves and product-limit estimates."""
