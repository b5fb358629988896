"""Stream and table analytics as plain DataFrame functions on Spark."""
