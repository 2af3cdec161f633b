"""chunkloom: a PySpark-native engine for text segmentation and the data work around it."""
