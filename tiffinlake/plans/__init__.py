"""Queries over the food_orders table."""
