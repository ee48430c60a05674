"""wayfare: public-transport and street-network analytics on Spark DataFrames."""
