"""Tables of a data set and scratch space shared by all executors."""
