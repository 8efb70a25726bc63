"""DataFrame in, DataFrame out. No operator here reads or writes storage."""
