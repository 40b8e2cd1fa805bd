"""Vector quantization, index codecs and training-data operators on Spark."""
