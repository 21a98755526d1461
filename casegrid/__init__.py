"""Line-list analytics on Spark: operators over case tables, declared as DataFrame plans."""
