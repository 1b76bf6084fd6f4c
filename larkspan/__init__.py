"""Fuel-plan analytics on Spark: station data, prices, corridors, plan search and the measurements around them."""
