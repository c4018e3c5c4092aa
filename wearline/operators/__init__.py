"""DataFrame -> DataFrame operators; every one takes its clock as an argument."""
