"""segloom: discourse segmentation, its evaluation and corpus preparation on Spark."""
