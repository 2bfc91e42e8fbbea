"""DataFrame in, DataFrame out. Each module holds one step of the forecast."""
