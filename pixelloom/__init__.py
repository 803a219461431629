"""pixelloom: image and tensor analytics expressed as Spark DataFrames."""
