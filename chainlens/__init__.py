"""Configuration change and evidence chains on Spark."""
