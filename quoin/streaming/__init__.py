"""Running state over streams, each with a batch twin."""
