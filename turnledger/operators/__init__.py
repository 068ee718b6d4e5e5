"""Reusable steps: DataFrame in, DataFrame out."""
