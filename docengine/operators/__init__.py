"""Operators: DataFrame to DataFrame. Every table carries ordinals; every arg-max breaks ties on them."""
